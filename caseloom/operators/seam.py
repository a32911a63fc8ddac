"""The one place where a user's model function plugs in.

The function takes a pandas frame (a batch, 1,000 rows and 2 MB at most or one larger row) and returns a frame of replies
with the same number of rows. A batch that fails is tried again row by row, so that one bad document only costs itself:
rows that still fail get ``model_error`` and the caller's documented fallback. A reply may also
have ``input_tokens`` and ``output_tokens``; they are kept next to it as the facts of the usage report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.frames import frame_runs

Model = Callable[[pd.DataFrame], pd.DataFrame]
USAGE = T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])


def apply_model(df: DataFrame, model: Model, inputs: Sequence[str], reply: T.StructType) -> DataFrame:
    """``df`` plus the reply columns, the token counts and ``model_error``. Filter rows out before this step:
    Spark does not push a later filter below a Python function."""
    inputs, reply = list(inputs), T.StructType([*reply.fields, *USAGE.fields])
    names = reply.fieldNames()

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        answer = model(batch[inputs])
        if len(answer) != len(batch):
            raise ValueError(f"model returned {len(answer)} rows for {len(batch)}")
        answer = answer.reset_index(drop=True).reindex(columns=names)
        return answer.assign(model_error=None)

    def one_by_one(batch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i in range(len(batch)):
            try:
                parts.append(ask(batch.iloc[i : i + 1]))
            except Exception as error:
                parts.append(pd.DataFrame([[None] * len(names) + [f"{type(error).__name__}: {error}"]],
                                          columns=[*names, "model_error"]))
        return pd.concat(parts, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frame_runs(batches):
            batch = batch.reset_index(drop=True)
            try:
                answer = ask(batch)
            except Exception:
                answer = one_by_one(batch)
            yield pd.concat([batch, answer.astype(object)], axis=1)

    schema = T.StructType([*df.schema.fields, *reply.fields, T.StructField("model_error", T.StringType())])
    return df.mapInPandas(run, schema)


def fill_template(template: str, **slots: Column) -> Column:
    """A prompt column: the template with each ``{slot}`` replaced by a column.

    Braces inside the inserted texts stay as they are; NULL inserts nothing.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in slots]
        found = [f for f in found if f[0] >= 0]
        if not found:
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), F.coalesce(slots[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))
