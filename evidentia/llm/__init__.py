"""Training-data operators: ten operators and the pipeline's shared tools.

Nothing outside this subpackage imports it.
"""
