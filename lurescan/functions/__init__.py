from lurescan.functions import labels, lexicon, text  # noqa: F401
