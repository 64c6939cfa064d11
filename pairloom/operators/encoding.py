"""Token ids by a stored tokeniser, and the texts back from them."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

_IDS = T.ArrayType(T.IntegerType(), containsNull=False)
# Characters encoded at once: the tokeniser keeps over a hundred bytes for each token until a slice is done.
SLICE = 1 << 18


def _shared(df: DataFrame, tokenizer: str):
    """The tokeniser's file, read on the driver and sent to the tasks; its size does not follow the data."""
    with open(tokenizer, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_with(df: DataFrame, tokenizer: str, cols: dict[str, str]) -> DataFrame:
    """Add id arrays: ``cols`` maps text columns to output columns. Null counts as empty text.

    With a byte-level tokeniser no text has an unknown token and ``decode_with`` gives it back exactly.
    """
    shared, most = _shared(df, tokenizer), SLICE

    @F.arrow_udf(_IDS)
    def encode(texts: pa.Array) -> pa.Array:
        # Spark's tasks are the threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = Tokenizer.from_str(shared.value)
        sizes, parts, waiting, length = [0], [np.empty(0, np.int32)], [], 0
        for at, text in enumerate(texts, 1):
            waiting.append(text.as_py())
            length += len(waiting[-1])
            if length >= most or at == len(texts):
                for found in known.encode_batch_fast(waiting, add_special_tokens=False):
                    parts.append(np.array(found.ids, np.int32))
                    sizes.append(len(parts[-1]))
                found, waiting, length = None, [], 0
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts)))

    return df.withColumns({out: encode(F.coalesce(F.col(c), F.lit(""))) for c, out in cols.items()})


def decode_with(df: DataFrame, tokenizer: str, cols: dict[str, str]) -> DataFrame:
    """Add texts: ``cols`` maps columns of ids to output columns. Null stays null."""
    shared = _shared(df, tokenizer)

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = Tokenizer.from_str(shared.value)
        # One row's ids are Python numbers at a time.
        flat, ends, valid = np.asarray(ids.values), np.asarray(ids.offsets), np.asarray(ids.is_valid())
        rows = zip(ends[:-1], ends[1:], valid, strict=True)
        return pa.array((known.decode(flat[a:b].tolist(), skip_special_tokens=False) if v else None for a, b, v in rows), pa.string())

    return df.withColumns({out: decode(F.col(c)) for c, out in cols.items()})
