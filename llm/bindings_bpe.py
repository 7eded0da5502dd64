"""Query of the BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers

from .bpe import encode_digests
from .common import table
from .registry import query


@query("op1_bpe_encode_decode")
def op1_bpe_encode_decode(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
