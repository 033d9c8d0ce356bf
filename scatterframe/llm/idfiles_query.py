"""Query op9: all documents' ids to files and back."""

from __future__ import annotations

import public_tokenizers

from .common import new_folder
from .idfiles import read_ids, write_ids
from .registry import read, register

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@register("op9_token_ids")
def op9(spark, sf_dir):
    path = new_folder(spark, "idfiles")
    write_ids(read(spark, sf_dir, "documents"), path, VOCABULARY)
    return read_ids(spark, path)
