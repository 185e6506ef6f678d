"""Token counts without identifiers: heap-and-linked-list pair merging.

A piece vocabulary (BPE with byte fallback, identity normaliser, dummy prefix) is
applied to whole texts. Text falls into runs of space marks followed by other
characters; no piece of such a vocabulary has a mark after another character, so
no merge crosses a run and each distinct run is merged once per worker.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import map_text
from datagauge.llm.kernels import Interner, buffers

MARK = "▁"
KEPT_RUNS = 300_000
_loaded: dict[str, tuple[dict[str, float], bool]] = {}


def load_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Ranks of mergeable pieces (lower merges first) and whether a text gets a leading mark."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("a piece has a space mark after another character; runs would not be independent")
        if any(c not in ranks for p in ranks for c in p):
            raise ValueError("a piece holds a character that is no piece; counts would not be initial symbols minus merges")
        _loaded[path] = ranks, bool(sp.encode("a", out_type=str)[0].startswith(MARK))
    return _loaded[path]


def merges(symbols: list, ranks: dict) -> int:
    """Merges done by popping the lowest-ranked adjacent pair, leftmost first, until none is left."""
    n, done = len(symbols), 0
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else -1
        if j < 0 or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = pair, None
        done += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(p := pair + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, p))
        if (h := before[i]) >= 0 and (r := ranks.get(p := symbols[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, p))
    return done


def count_run(run: str, ranks: dict[str, float]) -> int:
    """Tokens of one run: its symbols (a character outside the vocabulary is as many as its bytes) minus merges."""
    first = sum(1 if c in ranks else len(c.encode()) for c in run)
    return first - merges(list(run), ranks)


def runs_of(text: str) -> list[str]:
    """Runs of a text that has the dummy prefix, each without its first space mark."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, extra = [], 0
    for part in parts:
        if part:
            out.append(" " * extra + part)
            extra = 0
        else:
            extra += 1
    if extra:
        out.append(" " * (extra - 1))
    return out


def counter(path: str, column: str):
    ranks, prefix = load_pieces(path)
    if not prefix:
        raise ValueError("only vocabularies with a dummy prefix are handled")
    known, sizes = Interner(), [np.zeros(0, np.int64)]

    def work(batch):
        import pyarrow as pa

        texts = batch.column(column).to_pylist()
        codes, ends = [], []
        for text in texts:
            codes.extend(map(known.__getitem__, runs_of(text or "")))
            ends.append(len(codes))
        sizes.append(np.array([count_run(MARK + run.replace(" ", MARK), ranks) for run in known.fresh], np.int64))
        known.fresh.clear()
        sizes[:] = [np.concatenate(sizes)]
        total = np.concatenate([[0], np.cumsum(sizes[0][np.array(codes, np.int64)])])
        at = np.array([0, *ends])
        if len(known) > KEPT_RUNS:  # the most used stay
            used = np.bincount(codes, minlength=len(known))
            names, stay = list(known), np.flatnonzero(used > 1)[: KEPT_RUNS // 2]
            known.clear()
            for i in stay.tolist():
                known[names[i]]
            known.fresh.clear()
            sizes[:] = [sizes[0][stay]]
        _, offsets = buffers(batch.column(column))
        return [pa.array(np.diff(offsets)), pa.array(np.diff(total[at]))]

    return work


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each;
    null ids pass through; columns of `df` named like the new ones are replaced.
    Nothing is shuffled: one pass over the texts.
    """
    out = map_text(df, text, [("n_bytes", "bigint"), ("n_tokens", "bigint")], lambda: counter(model_path, text), keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
