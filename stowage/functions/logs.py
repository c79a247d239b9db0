"""Durable log lines of events, and what the classes of findings mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import human_size


def log_line(e: Column) -> Column:
    """The line of an event (source, event, label, detail, seconds, size, total, attempt); null for mere progress.

    The wording of the lines is fixed, since journals are searched for it.
    """
    label, detail = e["label"], e["detail"]
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    took = F.format_string("%.0fs", F.bround(e["seconds"].cast("double"), 0))
    resumed = F.when(e["size"] > 0, say(", resuming at ", human_size(e["size"]))).otherwise("")
    lines = {
        ("hash", "done"): say("hashed ", label, " in ", took),
        ("hash", "failed"): say("hash FAILED ", label, ": ", detail),
        ("backup", "done"): say("verified ", label, " in ", took),
        ("backup", "skipped"): say("skipped ", label, ": ", detail),
        ("backup", "failed"): say("FAILED ", label, ": ", detail),
        ("reclaim", "group"): say("group ", label, " (", human_size(e["size"]), ")"),
        ("reclaim", "verifying"): say("verifying ", label),
        ("reclaim", "relinked"): say("relinked ", label),
        ("reclaim", "foreign"): say("skipped ", label, " (foreign store — never touched)"),
        ("reclaim", "failed"): say("FAILED ", label, ": ", detail),
        ("fetch", "start"): say("downloading ", label, " (", F.coalesce(human_size(e["total"]), F.lit("size unknown")), ")", resumed),
        ("fetch", "hashing"): say("hashing ", label),
        ("fetch", "retry"): say("connection dropped — resuming ", label, " at ", human_size(e["size"]), " (attempt ", e["attempt"].cast("string"), ")"),
    }
    out = F.lit(None).cast("string")
    for (source, event), line in lines.items():
        out = F.when((e["source"] == source) & (e["event"] == event), line).otherwise(out)
    return out
