"""Training-data operators. Nothing outside this folder imports them, save the entry module and the pipeline."""
