"""An adaptive context-mixing range coder for sequences of token ids.

A sequence is cut into blocks that are coded apart, each from a fresh model and
with its own checksums, so any block can be read alone and a damaged one is
noticed and costs nothing but itself.

The model mixes three distributions of the next id:

* order 2: the id that last followed the two ids before (a hashed table), all on it;
* order 1: the two ids that mostly followed the id before, by how sure each is;
* order 0: all ids by how often they came in the block so far, counted after
  every id, each once to begin with.

The mixture's weights depend on how sure the contexts are and on whether they
agree; after each id every order's part in the probability that the id was
given moves its weight. The range coder codes an id by its share of the
mixture: first the candidates of orders 2 and 1 with all that the three orders
give them, then the other ids by their order-0 counts.

An id depends on all before it, so a block is coded id by id, by two functions of
byte strings in the JVM (``ContextCoder.java``, see jvm.py).

A block's form: magic, number of possible ids, number of ids, their crc32,
bytes of code, their crc32 (little-endian integers of four bytes), the code.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jvm

#: Ids in a block.
BLOCK_IDS = 32768
MOST_SIZE = 1 << 20
_FUNCTIONS = {"chronoloom_encode_ids": ("Encode", "binary"), "chronoloom_decode_ids": ("Decode", "binary")}


def encoded(spark: SparkSession, ids: Column, size: int) -> Column:
    """The coded block of ``ids`` (little-endian integers of four bytes, each below ``size``)."""
    assert 1 <= size <= MOST_SIZE
    jvm.register(spark, "ContextCoder", _FUNCTIONS)
    return jvm.call("chronoloom_encode_ids", ids, F.lit(size))


def decoded(spark: SparkSession, block: Column) -> Column:
    """The ids of a coded block; an error where a checksum differs."""
    jvm.register(spark, "ContextCoder", _FUNCTIONS)
    return jvm.call("chronoloom_decode_ids", block)
