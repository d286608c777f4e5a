"""Syntax repair by error-correcting chart parsing: the chart, the grammars and the lexers."""
