"""Query op7: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

import public_tokenizers

from .packing import pack_documents
from .registry import read, register

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@register("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), VOCABULARY)
