"""Rules of selectors, tables and limits on small documents."""

import json
import math
import random
import struct
from decimal import Decimal

import pytest

from sapwood.functions.failures import CODES, Limits, PlanFailure
from sapwood.functions.paths import EACH_INDEX, EACH_MEMBER, SELECTOR_TYPE, Selector, natural_keys, overlap
from sapwood.operators import contract, guard, native, route, table, values
from sapwood.sources import decode, relaxed
from sapwood.sources.decode import nodes


def test_selector_display_and_overlap():
    assert str(Selector.of("shop", "best buys", 12, EACH_MEMBER, EACH_INDEX)) == '.shop."best buys"[12][][*]'
    assert str(Selector()) == "." and str(Selector.of("ß", "7up", "", 'say"so', "_y")) == '."ß"."7up".""."say\\"so"._y'
    goods, head, inner = Selector.of("goods", EACH_INDEX), Selector.of("head"), Selector.of("goods", 4, "price")
    assert goods.may_overlap(inner) and inner.may_overlap(goods) and not goods.may_overlap(head)
    assert Selector.of(EACH_MEMBER).may_overlap(head) and not Selector.of(EACH_INDEX).may_overlap(head)
    assert len(CODES) == 15
    with pytest.raises(PlanFailure):
        route.checked([route.Capture("a", goods), route.Capture("b", inner)])


def test_overlap_of_columns_is_that_of_selectors(spark):
    held = [
        Selector.of("goods", EACH_INDEX),
        Selector.of("head"),
        Selector.of("goods", 4, "price"),
        Selector(),
        Selector.of(EACH_MEMBER),
        Selector.of(EACH_INDEX, "goods"),
    ]
    steps = lambda s: [(None, None, x[1]) if isinstance(x, tuple) else (None, x, None) if isinstance(x, int) else (x, None, None) for x in s.steps]
    pairs = spark.createDataFrame(
        [(i, j, steps(a), steps(b)) for i, a in enumerate(held) for j, b in enumerate(held)],
        f"i int, j int, a {SELECTOR_TYPE}, b {SELECTOR_TYPE}",
    )
    for r in pairs.select("i", "j", overlap(pairs.a, pairs.b).alias("overlap")).collect():
        assert r["overlap"] == held[r["i"]].may_overlap(held[r["j"]])


COLUMNS = '[{"title":"Colour","path":["look","colour"]},{"title":"Third","path":["sizes",2]}]'
DOCS = {
    "early": '{"items":[{"look":{}}],"head":%s}' % COLUMNS,
    "never": '{"about":null}',
    "untitled": '{"head":[{"title":"Colour","path":["look"]},{"title":5,"path":["x"]}],"items":[]}',
    "pathless": '{"head":[{"title":"Colour"}],"items":[]}',
    "object": '{"head":{"title":"Colour","path":["look"]},"items":[]}',
    "negative": '{"head":[{"title":"Last","path":["sizes",-3]}],"items":[]}',
    "twice": '{"head":%s,"head":%s,"items":[]}' % (COLUMNS, COLUMNS),
    "good": '{"head":%s,"items":[{"sizes":[7,8,9]},{"look":{"colour":{"r":1,"g":[2]}}},"plain"]}' % COLUMNS,
}


def test_metadata_rules(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, content string")
    held = nodes(docs, format="json", duplicates="all")
    schemas, rows = table.table(held, Selector.of("items", EACH_INDEX), table.Metadata(Selector.of("head")))
    got = {r["doc_id"]: r["fail"] and (r["fail"]["code"], r["fail"]["path"]) for r in schemas.collect()}
    assert got == {
        "early": ("INPUT_ORDER_VIOLATION", ".items[0]"),
        "never": ("INPUT_INVALID", ".head"),
        "untitled": ("INPUT_INVALID", ".head[1]"),
        "pathless": ("INPUT_INVALID", ".head[0]"),
        "object": ("INPUT_INVALID", ".head"),
        "negative": ("INPUT_INVALID", ".head[0]"),
        "twice": ("INPUT_ORDER_VIOLATION", ".head"),
        "good": None,
    }
    shown = [(r["row_no"], [(c["kind"], c["str"], c["num"]) for c in r["cells"]]) for r in rows.orderBy("row_no").collect()]
    gone = ("missing", None, None)
    assert shown == [(1, [gone, ("number", None, 9.0)]), (2, [("string", '{"r":1,"g":[2]}', None), gone]), (3, [gone, gone])]
    # the native way sees all but order and repeats
    failed = {r["doc_id"]: r["fail"] and r["fail"]["path"] for r in native.described(docs, Selector.of("head")).collect()}
    assert failed == {d: f and f[1] for d, f in got.items()} | {"early": None, "twice": None}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 3


def test_native_names_with_quotes_and_indexes(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, json.dumps({"it's": [5, {'say "no"': {"it's \"so\"": [6, 7]}}]}))], "doc_id long, content string")
    at = lambda *steps: native.value_at(F.try_parse_json("content"), steps, "string")
    got = docs.select(at("it's", 0), at("it's", 1, 'say "no"', "it's \"so\"", 1), at("it's", 9), at("")).first()
    assert tuple(got) == ("5", "7", None, None)


def test_contract_on_every_kind_of_bad_stream(spark):
    streams = [
        "k",
        "{ 1",
        "{ k k",
        "{ k }",
        "[ }",
        "{ ]",
        "]",
        "1 1",
        "end",
        "[ end",
        "1 end end",
        "[ k",
        "{ k 1 } end",
        "[ { k 1 } [ ] ] end",
        "1 end",
        "{ } 1",
    ]
    kinds = {"k": "key", "1": "number", "{": "object_start", "}": "object_end", "[": "array_start", "]": "array_end", "end": "end"}
    rows = [(i, n, kinds[e], "a" if e == "k" else None) for i, s in enumerate(streams) for n, e in enumerate(s.split())]
    got = {r["doc_id"]: r["seq"] for r in contract.protocol_errors(spark.createDataFrame(rows, "doc_id long, seq long, kind string, key_name string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0, 7: 1, 8: 0, 9: 1, 10: 2, 11: 1, 15: 2}


def test_number_texts(spark):
    want = {
        1e22: "1" + "0" * 22,
        1e-20: "0." + "0" * 19 + "1",
        -2.5e-9: "-0.0000000025",
        8.41e21: "8410000000000000000000",
        2.0**-1074: "0." + "0" * 323 + "5",
        1.7976931348623157e308: "17976931348623157" + "0" * 292,
        1e15: "1" + "0" * 15,
        123456.75: "123456.75",
        9007199254740993.0: "9007199254740992",
        float("nan"): "null",
        float("-inf"): "null",
    }
    rng = random.Random(5)
    for _ in range(300):
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            want[x] = f"{Decimal(repr(x)):f}".removesuffix(".0") if "." in f"{Decimal(repr(x)):f}" else f"{Decimal(repr(x)):f}"
    df = spark.createDataFrame([*want.items(), (0.0, "0"), (-0.0, "-0")], "num double, want string")
    bad = [(r["num"], r["got"], r["want"]) for r in df.select("num", "want", values.number_text(df.num).alias("got")).collect() if r["got"] != r["want"]]
    assert bad == []
    assert df.select(values.number_text(df.num, df.want)).where("false").count() == 0


def test_equality_of_values(spark):
    pairs = [
        ('{"a":1}', '{"a":1.0}', True),
        ('{"a":1,"b":2}', '{"b":2,"a":1}', False),
        ("[0]", "[-0.0]", False),
        ('"x"', '"x"', True),
        ("[[]]", "[{}]", False),
        ("[1]", "[1,2]", False),
    ]
    sides = [nodes(spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "doc_id long, content string"), format="json") for k in (0, 1)]
    assert {r["doc_id"]: r["equal"] for r in values.equal(*sides).collect()} == {i: p[2] for i, p in enumerate(pairs)}
    kinds = spark.createDataFrame([(k,) for k in ("key", "end", "array_start", "object_end", "null")], "kind string")
    assert [tuple(r) for r in kinds.select(values.is_start(kinds.kind), values.is_end(kinds.kind), values.is_scalar(kinds.kind)).collect()] == [(False,) * 3, (False,) * 3, (True, False, False), (False, True, False), (False, False, True)]


def test_refused_scopes_and_capture_metrics(spark):
    from pyspark.sql import functions as F

    docs = nodes(spark.createDataFrame([(1, '{"a":[1,[2,3],"é"]}'), (2, '{"a":[4]}')], "doc_id long, content string"), format="json")
    got = route.route(docs, [route.Capture("x", Selector.of("a", EACH_INDEX))], refuse=F.col("kind") == "array")
    assert [(r["doc_id"], r["path"], r["value"], r["fail"] and r["fail"]["code"]) for r in got.orderBy("doc_id", "ord").collect()] == [(1, ".a[0]", "1", None), (1, ".a[1]", None, "ABORTED"), (2, ".a[0]", "4", None)]
    held = route.metrics(route.route(docs, [route.Capture("x", Selector.of("a", EACH_INDEX))]))
    assert sorted(map(tuple, held.collect())) == [(1, 3, 24 + 64 + 18, 64), (2, 1, 24, 24)]


def test_guarded_keeps_what_comes_before_the_breach(spark):
    docs = nodes(spark.createDataFrame([(1, '["ab","abcd","a"]'), (2, '["a"]')], "doc_id long, content string"), format="json")
    kept = guard.guarded(docs, Limits(max_scalar_bytes=3))
    assert sorted((r["doc_id"], r["pre"]) for r in kept.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    with pytest.raises(Exception, match="RESOURCE_LIMIT_EXCEEDED"):
        guard.guarded(docs, Limits(max_scalar_bytes=3), strict=True).collect()


def test_abort_by_tag(spark):
    import threading
    import time

    slow = spark.range(0, 8, 1, 8).rdd.map(lambda r: time.sleep(20) or r.id)
    threading.Timer(4, guard.abort, (spark, "of-this-test")).start()
    with pytest.raises(PlanFailure, match="ABORTED"), guard.abortable(spark, "of-this-test"):
        slow.count()
    assert spark.range(3).count() == 3


def test_natural_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([({k: 1 for k in ("row~11", "row~9", "row~1234567890", "b", "a~2", "a", "7", "12")},)], "m map<string,int>")
    got = df.select(
        natural_keys(df.m).alias("n"),
        natural_keys(df.m, F.array(F.lit("b"), F.lit("zz"), F.lit("row~9"), F.lit("b"))).alias("f"),
    ).first()
    assert got["n"] == ["7", "12", "a", "a~2", "b", "row~1234567890", "row~9", "row~11"] or got["n"].index("row~9") < got["n"].index("row~11")
    assert got["f"][:2] == ["b", "row~9"] and len(got["f"]) == 8


def test_inferred_tables_and_missing_values(spark):
    docs = spark.createDataFrame(
        [(1, '[{"b":1,"a":"x"},{"a":"y"},[2]]'), (2, '[1,{"a":2},[3]]'), (3, "[]"), (4, "[[],[1]]")],
        "doc_id long, content string",
    )
    schemas, rows = table.table(nodes(docs, format="json"), Selector.of(EACH_INDEX), "infer")
    assert {r["doc_id"]: r["labels"] for r in schemas.collect()} == {1: ["b", "a"], 2: ["value"], 3: [], 4: []}
    shown = {(r["doc_id"], r["row_no"]): [c["str"] or c["num"] or c["kind"] for c in r["cells"]] for r in rows.collect()}
    assert shown[1, 2] == ["missing", "y"] and shown[1, 3] == ["missing", "missing"]
    assert (shown[2, 2], shown[2, 3], shown[4, 2]) == (['{"a":2}'], ["[3]"], [])
    schemas, rows = table.table(nodes(docs.where("doc_id = 1"), format="json"), Selector.of(EACH_INDEX), [table.TableColumn("B", ("b",), "error")])
    fail = schemas.first()["fail"]
    assert (fail["code"], fail["path"], rows.count()) == ("MISSING_VALUE", "[1].b", 1)


def test_limits(spark):
    docs = spark.createDataFrame(
        [("deep", "[[[1]]]"), ("key", '{"日":1}'), ("text", '["日本"]'), ("fine", '[1.50,"é",null]'), ("broken", '{"a": 1,\n "b": }')],
        "doc_id string, content string",
    )
    found = {r["doc_id"]: (r["fail"]["code"], r["fail"]["limit"], r["fail"]["row"], r["fail"]["col"]) for r in guard.violations(nodes(docs, format="json"), Limits(max_depth=2, max_key_bytes=2, max_scalar_bytes=5)).collect()}
    assert found == {d: ("RESOURCE_LIMIT_EXCEEDED", n, None, None) for d, n in (("deep", "max_depth"), ("key", "max_key_bytes"), ("text", "max_scalar_bytes"))} | {"broken": ("INPUT_INVALID", None, 2, 7)}
    sizes = {r["doc_id"]: r["bytes"] for r in values.byte_sizes(nodes(spark.createDataFrame([("a", '{"a":"é"}'), ("b", "[1.50]")], "doc_id string, content string"), format="json")).collect()}
    assert sizes == {"a": 35, "b": 40}


def test_formats_agree_on_shapes(spark):
    rows = [
        ("yaml", "plain: &p\n  size: 3\nbest:\n  <<: *p\n  rank: 0x1F\n", '{"plain":{"size":3},"best":{"rank":31,"size":3}}'),
        ("yaml", "shop: {open: 9}\nshop: {close: 17}\n", '{"shop":{"open":9,"close":17}}'),
        ("yaml", "one: 1\n---\ntwo: ~\n", '[{"one":1},{"two":null}]'),
        ("yaml", "", "null"),
        ("yaml", "[.inf, 1:30, 0b11, -017, 1_0.5, 0x1F, .5, 7e2]", '[null,90,3,-15,10.5,31,0.5,"7e2"]'),
        ("toml", "n = -" + "9" * 400, '{"n":null}'),
        ("jsonic", "0x_ 0x_f 1_0", '["0x_",15,10]'),
        ("ini", "top = yes\n[part]\nleft = right\n", '{"top":"yes","part":{"left":"right"}}'),
        ("toml", "n = 4\n[deep]\nlist = [false, 0.25]\n", '{"n":4,"deep":{"list":[false,0.25]}}'),
        ("csv", 'name,note\nAda,"to be, or"\n', '[{"name":"Ada","note":"to be, or"}]'),
        ("jsonl", '{"k":5}\n\n{"l":[6.0]}\n', '[{"k":5},{"l":[6]}]'),
        ("jsonc", '{"k":5 /* five */, // first\n "l":["/*"],}', '{"k":5,"l":["/*"]}'),
        ("json5", "{hue:0xFf,'dim':[.25,+7,3.,-2E1,],\"deep\":{a:null}, deep:{b:'it\\'s\\u00e9\\ud83d\\ude00'},/* , */}", '{"hue":255,"dim":[0.25,7,3,-20],"deep":{"a":null,"b":"it\'sé😀"}}'),
        ("json5", "'one \\\nline' // end", '"one line"'),
        ("json5", "{l:[1,{a:2}],l:[9,{b:3},4]}", '{"l":[9,{"a":2,"b":3},4]}'),
        ("jsonic", "left:up,sizes:[7 8,'9'],in:{on:false}", '{"left":"up","sizes":[7,8,"9"],"in":{"on":false}}'),
        ("jsonic", "[1,k:{x:2},,three,]", '[1,null,"three"]'),
        ("jsonic", "{k:1}\n{l:}\n# nothing", '[{"k":1},{"l":null}]'),
        ("jsonic", "a:b:1,a:c:0b11", '{"a":{"b":1,"c":3}}'),
        ("jsonic", "  ", "null"),
        ("jsonic", "{}", "{}"),
        ("zon", ".{ .one = 1_000, .@\"t wo\" = .{ .red, 'A', true, -0x10, 1e-1 }, .text =\n \\\\up\n \\\\down\n, .none = .{} }", '{"one":1000,"t wo":["red",65,true,-16,0.1],"text":"up\\ndown","none":{}}'),
    ]
    docs = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(rows)], "doc_id long, format string, content string")
    got = {r["doc_id"]: r["text"] for r in values.json_text(nodes(docs)).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(rows)}


def test_half_characters_and_many_rows_in_one_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(i, '["\\ud800x",{"\\udfff":%d}]' % i) for i in range(5)] + [(9, "[")], "doc_id long, content string")
    monkeypatch.setattr(decode, "ROWS", 3)
    got = {r["doc_id"]: r["text"] for r in values.json_text(nodes(docs, format="json")).collect()}
    assert got == {i: '["?x",{"?":%d}]' % i for i in range(5)}
    assert nodes(docs, format="json").where("fail is not null").count() == 1


@pytest.mark.parametrize("format, text", [("xml", "<a>t<b k='1'/>u<c><d>x</d>y</c></a>"), ("json", '{"a":[1,{"b":[2,3],"b":4}],"c":{"d":{}},"a":[5,[6]]}')])
def test_a_document_is_passed_on_in_pieces(monkeypatch, format, text):
    """No more rows than ROWS are held of one document, and they tell the same."""

    def rows(n):
        monkeypatch.setattr(decode, "ROWS", n)
        into, got = decode.Columns(), []

        def take():
            assert len(into) <= n
            for i in range(len(into)):
                (a, b), (x, y) = into.path_ends[i : i + 2], into.above_ends[i : i + 2]
                scalars = [getattr(into, name)[i] for name in decode.Columns.SCALARS]
                got.append((*scalars, into.keys[a:b], into.indexes[a:b], into.above[x:y]))
            into.clear()

        for _ in decode.walk(decode.DECODERS[format](text, False), "last_wins", into, 0):
            take()
        take()
        return got

    whole = rows(1000)
    assert len(whole) > 6 and whole[0][1] == len(whole) - 1
    assert all(rows(n) == whole for n in (2, 3, 5))


@pytest.mark.parametrize("read, line", [("json5", "{a:1},"), ("zon", ".{ .a = 1 },"), ("jsonic", "a b\n")])
def test_tokens_are_not_held(read, line):
    """A relaxed text is read with a token or two at hand; a fault of a later token is told before one of order."""
    head, tail = {"json5": ("[", "]"), "zon": (".{", "}"), "jsonic": ("", "")}[read]
    held, take = [], relaxed._Tokens.take

    class Tokens(relaxed._Tokens):
        def take(self):
            held.append(len(self.held))
            return take(self)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(relaxed, "_Tokens", Tokens)
        assert len(getattr(relaxed, read)(head + line * 50 + tail)) in (50, 100)
        assert held and max(held) <= 2
        with pytest.raises(decode.Malformed, match="no token"):
            getattr(relaxed, read)("}" + line + "'")


def test_failures_tell_where(spark):
    rows = [
        ("json", '{"a": 1,\n "b": }', 2, 7),
        ("toml", "a = 1\nb = = 2\n", 2, 5),
        ("ini", "[s]\na = 1\nnothing\n", 3, None),
        ("csv", 'a,b\n1,2\n3,"x\n', 3, None),
        ("yaml", "a: 1\nb: [1\n", 3, 1),
        ("xml", "<a>\n<b></a>", 2, 6),
        ("json5", "{a:1,\n b 2}", 2, 4),
        ("json5", "[1", 1, 3),
        ("json5", "[010]", 1, 2),
        ("jsonic", "a:[1\n }", 2, 2),
        ("jsonic", "{a}", 1, 1),
        ("zon", ".{ .x = 5,\n .x = 6 }", 2, 2),
        ("zon", ".{ .x = 5, 6 }", 1, 12),
        ("tsv", "a", None, None),
    ]
    docs = spark.createDataFrame([(i, f, t) for i, (f, t, *_) in enumerate(rows)], "doc_id long, format string, content string")
    got = {r["doc_id"]: (r["fail"]["code"], r["fail"]["row"], r["fail"]["col"]) for r in nodes(docs).collect()}
    assert got == {i: ("INPUT_INVALID", row, col) for i, (_, _, row, col) in enumerate(rows)}


def test_csv_cells_beyond_the_header_and_of_any_length(spark):
    long = "x" * 200_000
    docs = spark.createDataFrame([(1, f"a,b\n1,{long}\n2\n"), (2, "a,3\n1,2,3,4\n")], "doc_id long, content string")
    got = {r["doc_id"]: r["text"] for r in values.json_text(nodes(docs, format="csv")).collect()}
    assert got == {1: f'[{{"a":"1","b":"{long}"}},{{"a":"2"}}]', 2: '[{"a":"1","3":"2","_3":"3","4":"4"}]'}
