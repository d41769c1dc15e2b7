"""Vector expressions on array columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.numbers import round_stat

HASH_BYTES = 32
HASH_DIMENSIONS = 1536
SCORE_PLACES = 6


def hash_embedding(text: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """Deterministic vector: bytes of sha256(lower(text) + "_" + i), mapped to [-1, 1)."""
    blocks = -(-dimensions // HASH_BYTES)
    words = HASH_BYTES // 4

    def word(digest: Column, j: Column) -> Column:
        return F.conv(F.substring(digest, j * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    def block(lowered: Column, i: Column) -> Column:
        digest = F.sha2(F.concat(lowered, F.lit("_"), i.cast("string")), 256)
        # a lambda over a one-element array binds a value, so that it is computed once
        return F.flatten(
            F.transform(
                F.array(digest),
                lambda d: F.flatten(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(words - 1)),
                        lambda j: F.flatten(
                            F.transform(
                                F.array(word(d, j)),
                                lambda w: F.array(
                                    *[
                                        (F.shiftright(w, shift).bitwiseAND(F.lit(255)).cast("double") - 128.0) / 128.0
                                        for shift in (24, 16, 8, 0)
                                    ]
                                ),
                            )
                        ),
                    )
                ),
            )
        )

    parts = F.flatten(
        F.flatten(
            F.transform(
                F.array(F.lower(text)),
                lambda lowered: F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: block(lowered, i)),
            )
        )
    )
    return parts if blocks * HASH_BYTES == dimensions else F.slice(parts, 1, dimensions)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def magnitude(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL when either side has no length."""
    return F.try_divide(dot(a, b), magnitude(a) * magnitude(b))


def score(value: Column) -> Column:
    """A score as it is reported; ranking uses the full one."""
    return round_stat(value, SCORE_PLACES)

