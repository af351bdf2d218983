"""Token counts by the whole-token shortcut.

A sentencepiece BPE model whose pieces never hold the space mark after another
character can't merge across the start of a run of spaces, so a text is a
sequence of pre-tokens, each a run of marks and what follows up to the next
run.  Which vocabulary strings encode alone as one token is proved once, by
encoding each of them; a pre-token among those counts one without any merging.
Only the rest are merged, each distinct one once for as long as the task's memo
holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_fields

MARK = "▁"
#: Distinct pre-tokens whose counts a task remembers before it starts anew.
MEMO = 1_000_000


@lru_cache(maxsize=2)
def load(path: str):
    """The model, and the strings that stand for one token each when they come
    after a space: proved by encoding, not by looking at the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
    if crossing or model.encode("a  b", out_type=str)[0] != MARK + "a":
        raise ValueError(f"pre-tokens of this model aren't independent: {crossing[:3]}")
    heads = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    whole = frozenset(w for w, ids in zip(heads, model.encode(heads, num_threads=1), strict=True) if len(ids) == 1)
    return model, whole


def counter(path: str):
    """text -> number of tokens, exactly as the library's encode()."""
    model, whole = load(path)
    memo: dict[str, int] = {}
    known = whole.__contains__

    def count(text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        # The model puts one mark before the text.  A pre-token is kept without
        # its last mark; those before it (runs of spaces) show as empty strings.
        words = text.split(" ")
        if "" in words:
            glued, run = [], 0
            for w in words:
                if w:
                    glued.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            if run:
                glued.append(" " * (run - 1))
            words = glued
        rest = list(filterfalse(known, words))
        total = len(words) - len(rest)
        new = [w for w in dict.fromkeys(rest) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(dict.fromkeys(rest))
            # encode() puts the mark before each; "" is a mark alone
            memo.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
            if "" in memo:
                memo[""] = 1
        return total + sum(map(memo.__getitem__, rest))

    return count


def count_tokens(docs: DataFrame, model_path: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the model's encode() without begin or end tokens.  A
    null or empty text has 0 bytes and 0 tokens; repeated rows count each;
    other columns pass through, but for those of the three names, which are
    replaced.  An empty table gives an empty table.
    """

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        count = counter(model_path)
        for t in tables:
            n = [count(x) for x in t.column("text").to_pylist()]
            size = pc.fill_null(pc.binary_length(t.column("text")), 0).cast(pa.int64())
            yield pa.table({"n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return with_fields(docs, fn, {"text": text}, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())])
