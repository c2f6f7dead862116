"""Streams of text pieces of one reply: reasoning split from the answer, and endings held back.

Each is a state machine over the pieces of a key in order. The same machine runs in Structured Streaming, one state a
key, and in batch over the whole text; how a text is cut into pieces doesn't change what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: the marker that ends the reasoning.
END_OF_THOUGHT = "</think>"
#: A sentence is let go at its end or at so many characters; an ending is held up to so many.
SENTENCE_ENDS, SENTENCE_MOST, TAIL_MOST = "。！？!?\n.", 120, 400


def held_back(text: str, marker: str) -> int:
    """Length of the longest end of ``text`` that begins the marker without being all of it."""
    return next((k for k in range(min(len(text), len(marker) - 1), 0, -1) if marker.startswith(text[-k:])), 0)


def split_thought(state: tuple[str, bool], piece: str, marker: str = END_OF_THOUGHT, last: bool = False) -> tuple[tuple[str, bool], str, str]:
    """Next state, and what of the piece is reasoning and what is answer. state: (held text, marker seen)."""
    text, seen = state[0] + piece, state[1]
    if seen:
        return ("", True), "", text
    head, found, rest = text.partition(marker)
    if found:
        return ("", True), head, rest
    keep = 0 if last else held_back(text, marker)
    return (text[len(text) - keep :], False), text[: len(text) - keep], ""


def guard_tail(state: str, piece: str, disclaimer: str, last: bool = False) -> tuple[str, str]:
    """Next held text and what is let go: whole sentences, but for those from a disclaimer word on, which are held.

    At the end a held ending with the word is dropped if it is at most TAIL_MOST characters long, else let go.
    """
    text, out = state + piece, ""
    while text:
        ends = [text.find(c) for c in SENTENCE_ENDS if c in text]
        cut = min(ends) + 1 if ends else SENTENCE_MOST if len(text) > SENTENCE_MOST else 0
        cut = min(cut, SENTENCE_MOST) if cut else 0
        if not cut:
            break
        if disclaimer in text[:cut]:
            if len(text) <= TAIL_MOST:
                break
            cut = max(cut, 1)
        out, text = out + text[:cut], text[cut:]
    if last:
        out, text = out + ("" if disclaimer in text and len(text) <= TAIL_MOST else text), ""
    return text, out


def split_stream(pieces: DataFrame, timeout: str | None = None) -> DataFrame:
    """Streaming: pieces (request, seq, piece, last) to (request, seq, reasoning, answer), state kept per request.

    A micro-batch's pieces are taken in order of seq. With a timeout (and processing time), a request that stays
    silent lets its held text go as reasoning.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held, seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], -1, "" if seen else held, "")], columns=["request", "seq", "reasoning", "answer"])
            return
        now = state.get if state.exists else ("", False)
        rows = pd.concat(batches).sort_values("seq")
        out = []
        for r in rows.itertuples():
            now, thought, answer = split_thought(now, r.piece or "", last=bool(r.last))
            out.append((key[0], r.seq, thought, answer))
        if len(rows) and bool(rows["last"].iloc[-1]):
            state.remove() if state.exists else None
        else:
            state.update(now)
            if timeout:
                state.setTimeoutDuration(timeout)
        yield pd.DataFrame(out, columns=["request", "seq", "reasoning", "answer"])

    kind = dict(pieces.dtypes)
    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return pieces.groupBy("request").applyInPandasWithState(run, f"request {kind['request']}, seq {kind['seq']}, reasoning string, answer string", "held string, seen boolean", "append", mode)


def split_batch(pieces: DataFrame) -> DataFrame:
    """Batch: (request, reasoning, answer) of whole requests, by splitting the joined text in SQL."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    d = pieces.groupBy("request").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["piece"], F.lit(""))), "").alias("t"))
    at = F.locate(END_OF_THOUGHT, F.col("t"))
    return d.select("request", F.when(at > 0, F.left("t", at - 1)).otherwise(F.col("t")).alias("reasoning"), F.when(at > 0, F.substring("t", at + len(END_OF_THOUGHT), F.length("t"))).otherwise(F.lit("")).alias("answer"))


def guard_batch(texts: DataFrame, disclaimer: str) -> DataFrame:
    """(id, text) without a closing disclaimer, as the piecewise guard lets it through; null texts are empty.

    Of a whole text, what goes is the end from the first sentence on that holds the word with no more than TAIL_MOST
    characters left. The sentences pass with a count of characters, so a text of any length takes one pass.
    """
    ends, most = SENTENCE_ENDS.replace("\n", r"\n"), SENTENCE_MOST
    sentences = F.regexp_extract_all("text", F.lit(f"[^{ends}]{{0,{most - 1}}}[{ends}]|[^{ends}]{{1,{most}}}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("cut"))

    def step(a: Column, x: Column) -> Column:
        goes = a["cut"].isNull() & F.contains(x, F.lit(disclaimer)) & (F.length("text") - a["at"] <= TAIL_MOST)
        return F.struct((a["at"] + F.length(x)).alias("at"), F.when(goes, a["at"]).otherwise(a["cut"]).alias("cut"))

    d = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("id", F.left("text", F.coalesce(F.aggregate(sentences, start, step, lambda a: a["cut"]), F.length("text"))).alias("text"))
