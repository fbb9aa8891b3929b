"""Token counts of whole texts with a public tokenizer, read from a file whose path is a parameter."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of a byte-level BPE: one line per token, its bytes in base64 and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging. Fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("loaded", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches):
        encoding = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoding = encoding or load(path)
            texts = batch.column("text").to_pylist()
            whole = [len(encoding.encode_ordinary(t)) for t in texts]
            # the first line is what the rest answers to
            head = [len(encoding.encode_ordinary(h + "\n")) if (h := t.partition("\n")[0]) != t else 0 for t in texts]
            names = [*batch.schema.names[:-1], "tokens", "prompt_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(whole, pa.int64()), pa.array(head, pa.int64())], names=names)

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, prompt_tokens) of documents with a text of at least one character.

    ``source`` is without case and outer blanks. ``prompt_tokens`` is the size of the first line where others follow, else 0.
    Null and empty texts and null doc_ids give no row; repeated documents give repeated rows.
    """
    source = F.lower(F.trim("source")) if "source" in documents.columns else F.lit(None).cast("string")
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(tokenizer), "doc_id long, source string, tokens long, prompt_tokens long")
