"""Folding the chunks of streamed replies, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLDED = "stream_id string, response_content string, input_tokens bigint, output_tokens bigint, chunks bigint, complete boolean"
_STATE = "texts array<string>, seqs array<bigint>, usage_seq bigint, input_tokens bigint, output_tokens bigint, chunks bigint, last_seq bigint"


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """One row per reply from ``(stream_id, seq, text, prompt_tokens, output_tokens, is_last)``.

    Texts are joined in order; the counts are those of the last chunk with a count that is not 0. A chunk that was sent
    again counts once.
    """
    sent = F.struct(*[c for c in chunks.columns if c not in ("stream_id", "seq")])
    chunks = chunks.groupBy("stream_id", "seq").agg(F.min(sent).alias("_sent")).select("stream_id", "seq", "_sent.*")
    counted = (F.coalesce("prompt_tokens", F.lit(0)) != 0) | (F.coalesce("output_tokens", F.lit(0)) != 0)
    usage = F.struct(
        "seq", F.coalesce("prompt_tokens", F.lit(0)).alias("i"), F.coalesce("output_tokens", F.lit(0)).alias("o")
    )
    grouped = chunks.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("_texts"),
        F.max(F.when(counted, usage)).alias("_usage"),
        F.count("*").alias("chunks"),
        F.bool_or(F.coalesce("is_last", F.lit(False))).alias("complete"),
    )
    return grouped.select(
        "stream_id",
        F.array_join(F.transform("_texts", lambda t: t["text"]), "").alias("response_content"),
        F.coalesce("_usage.i", F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce("_usage.o", F.lit(0)).cast("bigint").alias("output_tokens"),
        "chunks",
        "complete",
    )


#: Last seq of a reply that has been given out; a mark is kept for chunks that are sent again.
DONE = -2


def _folder(idle_ms: int | None):
    """The state function, nested so that it travels to the workers by value."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Add new chunks of one reply to its state; emit when every chunk up to the end marker is there, or on timeout."""
        texts, seqs, usage_seq, tokens_in, tokens_out, count, last_seq = (
            state.get if state.exists else ([], [], -1, 0, 0, 0, -1)
        )

        def wait() -> None:
            if idle_ms:
                state.setTimeoutDuration(idle_ms)

        if last_seq == DONE:  # chunks sent again after the reply was given out
            if state.hasTimedOut:
                state.remove()
            else:
                list(batches)
                wait()
            return
        texts, seqs = list(texts), [int(x) for x in seqs]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).drop_duplicates("seq")
            rows = rows[~rows["seq"].isin(seqs)].sort_values("seq")
            texts += rows["text"].fillna("").tolist()
            seqs += rows["seq"].astype(int).tolist()
            count = len(seqs)
            used = rows[(rows["prompt_tokens"] != 0) | (rows["output_tokens"] != 0)]
            if len(used) and used["seq"].iloc[-1] > usage_seq:
                usage_seq, tokens_in, tokens_out = (int(used[c].iloc[-1]) for c in ("seq", "prompt_tokens", "output_tokens"))
            ends = rows.loc[rows["is_last"], "seq"]
            last_seq = int(ends.iloc[-1]) if len(ends) else last_seq
            if last_seq < 0 or count <= last_seq:
                state.update((texts, seqs, usage_seq, tokens_in, tokens_out, count, last_seq))
                wait()
                return
        complete = last_seq >= 0
        if state.hasTimedOut:
            state.remove()
        else:
            state.update(([], [], -1, 0, 0, 0, DONE))
            wait()
        ordered = [t for _, t in sorted(zip(seqs, texts))]
        yield pd.DataFrame(
            {
                "stream_id": [key[0]],
                "response_content": ["".join(ordered)],
                "input_tokens": [tokens_in],
                "output_tokens": [tokens_out],
                "chunks": [count],
                "complete": [complete],
            }
        )

    return fold


def fold_chunk_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """:func:`fold_chunks` on a stream: state per reply until its end marker.

    With ``idle_ms`` a reply that gets no chunk for so long is emitted as it is, marked incomplete, and no state stays
    for ever; it needs a trigger that keeps running, as a run over what is there would wait for the time to pass. Chunks that are sent again count once. ``seq`` counts from 0. A reply is one model answer, so its state is bounded by the model's
    output limit.
    """
    rows = chunks.select(
        "stream_id",
        F.col("seq").cast("bigint").alias("seq"),
        "text",
        F.coalesce("prompt_tokens", F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"),
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(_folder(idle_ms), FOLDED, _STATE, "append", timeout)
