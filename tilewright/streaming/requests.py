"""Requests that a client repeats until they are acknowledged: each is carried out once, and each try gets the same answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import InOrder, in_order


class _Answers(InOrder):
    """State per client: its requests that are not acknowledged yet, with the first try of each."""

    def open(self) -> None:
        self.first = self.handle.getMapState("first", "request string", "seq long")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.first.iterator()} if self.first.exists() else {}
        before, out = dict(held), []
        for _, seq, request, is_ack in rows:
            if is_ack:
                held.pop(request, None)
            else:
                out.append((seq, request, held.setdefault(request, seq), held[request] != seq))
        for request in before.keys() - held.keys():
            self.first.removeKey((request,))
        for request, seq in held.items():
            if before.get(request) != seq:
                self.first.updateValue((request,), (seq,))
        return out


def answered(tries: DataFrame, client: str, ts: str, seq: str, delay: str = "0 seconds") -> DataFrame:
    """(client, seq, request, first, repeated) of each try: the first try of its request, whose answer it gets, and whether it is another.

    ``tries`` also has request (a text; null ones are left out) and is_ack: the client has the answer and will not try
    again, so a later try of the same name is a new request. Rows count in the order of (time, seq), as a stream once
    the watermark has passed them; its state is the requests that wait for an acknowledgement.
    """
    rows = tries.where("request is not null").select(
        F.col(client).cast("long").alias(client), F.col(ts).cast("timestamp").alias("_ts"), F.col(seq).cast("long").alias("seq"), F.col("request").cast("string").alias("request"), F.coalesce("is_ack", F.lit(False)).alias("is_ack")
    )
    if tries.isStreaming:
        processor = _Answers("us long, seq long, request string, is_ack boolean", [client, "seq", "request", "first", "repeated"])
        return in_order(rows, client, "_ts", "seq", ["request", "is_ack"], processor, f"{client} long, seq long, request string, first long, repeated boolean", delay)
    order = Window.partitionBy(client, "request").orderBy("_ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.dropna(subset=[client, "_ts", "seq"]).withColumn("_acks", F.count_if("is_ack").over(order))
    first = F.first("seq").over(Window.partitionBy(client, "request", "_acks").orderBy("_ts", "seq"))
    found = rows.where("not is_ack").withColumn("first", first)
    return found.select(client, "seq", "request", "first", (F.col("first") != F.col("seq")).alias("repeated"))
