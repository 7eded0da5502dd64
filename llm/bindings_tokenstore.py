"""Query of the token store."""

from __future__ import annotations

import public_tokenizers

from meterline.session import scratch_path

from .common import table
from .registry import query
from .tokenstore import read_documents, write_tokens


@query("op4_repair_token_store")
def op4_repair_token_store(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")
