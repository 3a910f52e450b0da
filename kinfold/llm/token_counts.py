"""Token counts with the whole-token shortcut.

Offline, for a vocabulary, it is proved by encoding which of its strings stand alone as one token; a pre-token among them
counts one, without merges. Only the rest is merged, by the tokenizer itself, and what came out is remembered for a
bounded number of distinct pre-tokens.

Cases: null and empty texts have 0 tokens. Texts that hold an added token's string, or characters outside the scripts for
which splitting was checked, are given to the tokenizer whole. Very long texts are worked on whole. Repeated rows give
repeated results, an empty table none. Columns with the names in OUT are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Known, groups, in_letters, split

#: Fixed: this vocabulary's pattern for pre-tokens, after lower-casing.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct pre-tokens that a Python worker remembers beside the whole tokens, at about 20 bytes; beyond that it forgets
#: and starts anew.
REMEMBER = 3_000_000
OUT = ("n_bytes", "n_tokens", "over_limit")


def whole_tokens(path: str) -> set[str]:
    """The vocabulary's strings that the tokenizer encodes as exactly one token when they stand alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix = model["end_of_word_suffix"] or ""
    alone = regex.compile(SPLIT).fullmatch
    words = [w for w in (x.removesuffix(suffix) for x in model["vocab"] if x.endswith(suffix)) if w and w.isascii() and w == w.lower() and alone(w)]
    return {w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1}


class Counter:
    """Tokens of texts. A pre-token among the whole tokens counts 1 without merges; others are merged once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = whole_tokens(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.size = Known(), np.zeros(0, np.int64)

    def numbers(self, joined: str, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = self.known.find(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            words = [joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            n = [1 if w in self.whole else len(self.merges(in_letters(w))) for w in words]
            self.size = np.concatenate([self.size, np.array(n, np.int64)])
            out[new] = self.known.add(hashes[new])
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for rows, held in groups(texts, self.added):
            if rows[0] < 0:
                out[-1 - rows[0]] = len(self.tokenizer.encode(held[0], add_special_tokens=False).ids)
                continue
            if self.known.n >= REMEMBER:
                self.forget()
            joined, start, end, hashes, first = split([t.lower() for t in held], False)
            distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            number = self.numbers(joined, start[at], end[at], distinct)[which]
            total = np.concatenate([[0], np.cumsum(self.size[number])])[first]
            for row, k in zip(rows, np.diff(total).tolist(), strict=True):
                out[row] = k
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python worker, kept from task to task."""
    return Counter(path)


def counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the text, by default), n_bytes, n_tokens, over_limit. One narrow stage, no shuffle."""
    rest = [c for c in (df.columns if keep is None else keep) if c not in OUT and (c != text or keep is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(path).count(batch.column(batch.num_columns - 2).to_pylist())
            arrays = [*batch.columns[:-2], batch.columns[-1], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    source = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)), F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-2])), f"c{len(rest)} long, c{len(rest) + 1} long, c{len(rest) + 2} boolean"])
    return source.mapInArrow(run, schema).toDF(*rest, *OUT)
