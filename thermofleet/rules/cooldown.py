"""Which alerts go out when a sent alert silences its key for a while."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermofleet.functions.timekeys import hour_in_window
from thermofleet.operators.track import CHUNK, Track

LONG_AGO = -(1 << 62)


def _outline(times: np.ndarray, waits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a range of alerts: the next send after each (its length for none), and a table of breakpoints.

    The table says what the range does to a key that is silent until `s`: the first breakpoint at or after `s` has the time
    until which the key is silent behind the range. Alerts whose chains of sends meet share one breakpoint.
    """
    after = np.searchsorted(times, times + waits)
    until = (times + waits).tolist()
    for k in range(len(times) - 1, -1, -1):
        if after[k] < len(times):
            until[k] = until[after[k]]
    until = np.array(until, np.int64)
    ends = np.flatnonzero(np.append(until[1:] != until[:-1], True))
    return after, times[ends], until[ends]


def sent_times(alerts: DataFrame, by: Sequence[str], cooldown_seconds: Column | int, at: str = "raised_at") -> DataFrame:
    """Send times per key: the first alert, then always the first one at least a cooldown after the last send.

    The rule looks sequential, but a range of alerts acts on a key only through the time until which it is silent. Each range
    is outlined by itself as a table of breakpoints, a key's outlines are gone through one after the other, which tells every
    range where it starts, and the ranges then mark their sends, again each by itself. A key brings to one task only its
    outlines; they hold no more rows per range than there are alerts within one cooldown.
    """
    wait = F.lit(cooldown_seconds) if isinstance(cooldown_seconds, int) else cooldown_seconds
    times = alerts.groupBy(*by, at).agg((F.max(wait).cast("bigint") * 1_000_000).alias("__wait"))
    track, keys = Track(tuple(by), at), [*by, CHUNK]
    rows = track.chunked(times).select(*keys, F.unix_micros(F.col(at)).alias("__t"), "__wait")
    types = dict(rows.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def outline(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__t")
        _, start, until = _outline(frame["__t"].to_numpy(np.int64), frame["__wait"].to_numpy(np.int64))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "__t": start, "__until": until})

    def follow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        silent, entries = LONG_AGO, []
        for chunk, own in frame.sort_values([CHUNK, "__t"]).groupby(CHUNK, sort=True):
            entries.append((*key, chunk, silent))
            hit = np.searchsorted(own["__t"].to_numpy(), silent)
            if hit < len(own):
                silent = int(own["__until"].iloc[hit])
        return pd.DataFrame(entries, columns=[*keys, "__silent"])

    def mark(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__t")
        stamps = frame["__t"].to_numpy(np.int64)
        after, _, _ = _outline(stamps, frame["__wait"].to_numpy(np.int64))
        k, sent = int(np.searchsorted(stamps, frame["__silent"].iloc[0])), []
        while k < len(stamps):
            sent.append(stamps[k])
            k = int(after[k])
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "__t": np.array(sent, np.int64)})

    outlines = rows.groupBy(*keys).applyInPandas(outline, f"{head}, __t bigint, __until bigint")
    entries = outlines.groupBy(*by).applyInPandas(follow, f"{head}, __silent bigint")
    own = entries.select(*[F.col(k).alias(f"__e{k}") for k in keys], "__silent")
    met = rows.join(own, [F.col(k).eqNullSafe(F.col(f"__e{k}")) for k in keys]).select(*keys, "__t", "__wait", "__silent")
    marked = met.groupBy(*keys).applyInPandas(mark, f"{head}, __t bigint")
    return marked.select(*by, F.timestamp_micros("__t").alias(at))


def cooldown_scan(alerts: DataFrame, by: Sequence[str], cooldown_seconds: Column | int, at: str = "raised_at",
                  tie: Sequence[str] = ()) -> DataFrame:
    """Alerts with `sent`: of several at a send time only the first by `tie` goes out."""
    sent = sent_times(alerts, by, cooldown_seconds, at)
    if not tie:
        return alerts.join(sent.withColumn("sent", F.lit(True)), [*by, at], "left").withColumn(
            "sent", F.coalesce("sent", F.lit(False))
        )
    first = alerts.groupBy(*by, at).agg(F.min(F.struct(*tie)).alias("__first"))
    marks = first.join(sent, [*by, at], "left_semi")
    return alerts.join(marks, [*by, at], "left").withColumn(
        "sent", F.coalesce(F.struct(*tie) == F.col("__first"), F.lit(False))
    ).drop("__first")


def notification_gate(found: DataFrame, hour: Column, last_sent: DataFrame, now: Column, *, threshold: float = 1.5,
                      cooldown_seconds: int = 14_400, quiet: tuple[int, int] = (22, 7)) -> DataFrame:
    """Opportunities to announce now: outside quiet hours, large enough, and not inside their device's cooldown.

    `found` has `(site_id, device, action, cost_delta)`, `last_sent` `(site_id, device, sent_at)`.
    """
    big = found.filter((-F.col("cost_delta") >= threshold) & ~hour_in_window(hour, *quiet))
    joined = big.join(last_sent, ["site_id", "device"], "left")
    waiting = F.col("sent_at").isNotNull() & (F.unix_micros(now) - F.unix_micros("sent_at") < cooldown_seconds * 1_000_000)
    return joined.filter(~waiting).drop("sent_at")


def rollup(announce: DataFrame, open_before: DataFrame, open_now: DataFrame) -> DataFrame:
    """One message per site, or a dismissal where opportunities were open before and none are left.

    The collected lines are bounded by the devices of a site.
    """
    lines = announce.groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.struct("cost_delta", "device", "action"))).alias("items"),
        F.count(F.lit(1)).alias("n_items"),
    )
    sent = lines.select("site_id", F.lit("notify").alias("event"), "n_items", F.transform("items", lambda i: F.concat_ws(" ", i["action"], i["device"])).alias("lines"))
    drained = (
        open_before.select("site_id").distinct().join(open_now.select("site_id").distinct(), ["site_id"], "left_anti")
    )
    gone = drained.select(
        "site_id", F.lit("dismiss").alias("event"), F.lit(0).cast("bigint").alias("n_items"),
        F.array().cast("array<string>").alias("lines"),
    )
    return sent.unionByName(gone)
