"""The quality monitor on a stream of reports: a stop becomes a flag row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veldra.operators.monitor import OBSERVER_LEAST, OBSERVER_RATE, PARSE_RATE, STREAK, TOTAL_LEAST, TOTAL_RATE


def observer_flags(reports: DataFrame) -> DataFrame:
    """observer, seq and rule of each report at which an observer's streak or failure rate is over its limit.

    State for an observer: reports seen, failures, the last error and its run.
    Within a batch, reports count in order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, bad, last, run = state.get if state.exists else (0, 0, "ok", 0)
        out = []
        for seq, status in pd.concat(list(batches))[["seq", "status"]].sort_values("seq").itertuples(index=False):
            status = status or "missing"
            seen, bad = seen + 1, bad + (status != "ok")
            run = 0 if status == "ok" else run + 1 if status == last else 1
            last = status
            if run >= STREAK:
                out.append((key[0], seq, "streak"))
            elif seen >= OBSERVER_LEAST and bad / seen > OBSERVER_RATE:
                out.append((key[0], seq, "observer_rate"))
        state.update((seen, bad, last, run))
        yield pd.DataFrame(out, columns=["observer", "seq", "rule"])

    return reports.groupBy("observer").applyInPandasWithState(step, "observer long, seq long, rule string", "seen long, bad long, last string, run long", "append", GroupStateTimeout.NoTimeout)


def total_flags(reports: DataFrame) -> DataFrame:
    """seq and rule of each report at which the share of failures, or of parse errors, of all reports so far is over its limit.

    The order of all reports is one state by nature; what reaches it is a row
    for each report with two flags, and its state is three numbers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, bad, parse = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", ignore_index=True)
        n = total + 1 + rows.index.to_numpy()
        bads, parses = bad + rows["bad"].cumsum().to_numpy(), parse + rows["parse"].cumsum().to_numpy()
        state.update((total + len(rows), int(bads[-1]), int(parses[-1])))
        over, parse_over = (n >= TOTAL_LEAST) & (bads / n > TOTAL_RATE), (n >= TOTAL_LEAST) & (parses / n > PARSE_RATE)
        rows = rows.assign(rule=pd.Series("parse_rate", rows.index).mask(over, "total_rate"))[over | parse_over]
        yield rows[["seq", "rule"]]

    status = F.coalesce("status", F.lit("missing"))
    flags = reports.select(F.lit(0).alias("all"), "seq", (status != "ok").cast("int").alias("bad"), (status == "parse_error").cast("int").alias("parse"))
    return flags.groupBy("all").applyInPandasWithState(step, "seq long, rule string", "total long, bad long, parse long", "append", GroupStateTimeout.NoTimeout)

