"""Dictionary-driven text respelling and lexicon analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from graphie.functions.text import tokens as tokenize  # noqa: E402
from graphie.functions.text import weave as reassemble  # noqa: E402
from graphie.operators.dictionary import Dictionary, Metadata, merge_dictionaries  # noqa: E402
from graphie.operators.language import language_score  # noqa: E402
from graphie.operators.respell import respell, respell_guarded  # noqa: E402
from graphie.operators.rules import build_dictionary, extend_dictionary  # noqa: E402
from graphie.operators.search import build_index, search  # noqa: E402
from graphie.operators.segments import container_members, html_segments, interleaved  # noqa: E402
from graphie.operators.segments import member_segments as segments  # noqa: E402
from graphie.sources.dictionary_io import read_dictionary, write_dictionary  # noqa: E402
from graphie.streaming.streams import respell_stream  # noqa: E402

__all__ = [
    "Dictionary", "Metadata", "build_dictionary", "build_index", "container_members", "extend_dictionary",
    "html_segments", "interleaved", "language_score", "merge_dictionaries", "read_dictionary", "reassemble",
    "respell", "respell_guarded", "respell_stream", "search", "segments", "tokenize", "write_dictionary",
]
