"""Unique destination names: the first free of ``stem.ext``, ``stem_1.ext``, ``stem_2.ext`` ...

Files come in order and each takes the first name that is still free in its folder. Row
numbers alone give wrong names when ``a_1.txt`` is itself an input name next to two ``a.txt``.
The exact result needs only a few facts, and each is a grouped or chunked computation:

* rank j of a file among the files of the same name (0-based);
* for each distinct name that is also a numbered form ``stem_k`` of another name: the number c of
  files of that other name that come before its own first file;
* a walk over those numbered names in order of k, with one integer of state, that tells which of
  them were there first (the others skip that number) and which lost their name.

Only the walk is sequential. It reads distinct contested names, never files, as a stream of
sorted rows, so no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import stem, suffix
from caseloom.operators.ranking import CHUNK_ROWS, running_total
from caseloom.session import cut_lineage

_NUMBERED = r"(?s)^(.+)_([1-9][0-9]{0,17})$"
_ALL_NUMBERS = r"(?s)^(.+?)((?:_[1-9][0-9]{0,17})*)$"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    family = parent = None
    lost: set[str] = set()
    skipped = shift = 0
    for batch in batches:
        out = []
        for fam, group, par, k, child, before, files, matters in zip(
            batch["_family"], batch["_group"], batch["_parent"], batch["_k"], batch["_child"],
            batch["_before"], batch["_files"], batch["_matters"],
        ):
            if (group, fam) != family:
                family, parent, lost = (group, fam), None, set()
            if par != parent:
                parent, skipped, shift = par, 0, int(par in lost)
            reaches = k - skipped - shift
            if reaches >= files:
                continue
            if before <= reaches:
                skipped += 1
                out.append((group, par, reaches))
            else:
                if matters:
                    lost.add(child)
                out.append((group, child, 0))
        yield pd.DataFrame(out, columns=["_group", "_name", "_from"])


def _named(files: DataFrame, number: Column, folder: Sequence[str], order: str, name: str, out: str) -> DataFrame:
    fresh = F.concat(stem(F.col("_name")), F.lit("_"), number.cast("string"), suffix(F.col("_name")))
    return files.select(
        *folder, order, F.col("_name").alias(name), F.when(number == 0, F.col("_name")).otherwise(fresh).alias(out)
    )


def unique_names(
    df: DataFrame,
    folder: Sequence[str],
    name: str = "file_name",
    order: str = "ord",
    out: str = "dest_name",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Return ``folder`` columns, ``order``, ``name`` and the unique name ``out``.

    ``folder`` columns say which folder a file goes to; ``order`` is an integer unique inside a
    folder. Hand in a stored table: only these columns are read, more than once.
    """
    files = df.select(F.to_json(F.struct(*folder)).alias("_group"), *folder, F.col(order), F.col(name).alias("_name"))
    key = ["_group", "_name"]

    names = files.groupBy(*key).agg(F.count(F.lit(1)).alias("_files"), F.min(order).alias("_first"))
    parted = names.withColumn("_ext", suffix(F.col("_name"))).withColumn("_stem", stem(F.col("_name")))
    base = F.regexp_extract("_stem", _NUMBERED, 1)
    numbered = (
        parted.filter(F.rlike("_stem", F.lit(_NUMBERED)))
        .withColumn("_base", base)
        .filter((F.col("_ext") == "") | F.rlike("_base", F.lit(r"[^.]")))
        .select(
            "_group",
            F.concat("_base", "_ext").alias("_parent"),
            F.regexp_extract("_stem", _NUMBERED, 2).cast("long").alias("_k"),
            F.col("_name").alias("_child"),
            "_first",
        )
    )
    # A name used once keeps it unless it is a numbered form itself, so it can push nobody out.
    pushing = parted.filter((F.col("_files") > 1) | F.rlike("_stem", F.lit(_NUMBERED))).select(
        F.col("_group").alias("_pg"), F.col("_name").alias("_pn"), "_files"
    )
    contested = numbered.join(
        pushing, (numbered["_group"] == pushing["_pg"]) & (numbered["_parent"] == pushing["_pn"])
    ).drop("_pg", "_pn")
    # Only a name that has numbered forms of its own needs remembering when it loses its place.
    parents = contested.select(F.col("_group").alias("_pg"), F.col("_parent").alias("_pn")).distinct()
    contested = contested.join(
        parents, (contested["_group"] == parents["_pg"]) & (contested["_child"] == parents["_pn"]), "left"
    ).withColumn("_matters", F.col("_pn").isNotNull())
    contested = cut_lineage(contested.drop("_pg", "_pn"))
    if contested.isEmpty():
        # The usual case: no numbered form meets a name that is used twice, so ranks are the answer.
        ranked = running_total(files, key, order, F.lit(1), "_rank", chunk_rows=chunk_rows)
        return _named(ranked, F.col("_rank"), folder, order, name, out)

    blank = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in folder]
    probes = contested.select(
        "_group", *blank, F.col("_first").alias(order), F.col("_parent").alias("_name"),
        F.struct("_k", "_child", "_files", "_matters").alias("_probe"),
    )
    counted = running_total(
        files.withColumn("_probe", F.lit(None).cast(probes.schema["_probe"].dataType)).unionByName(probes),
        key, order, F.when(F.col("_probe").isNull(), 1).otherwise(0), "_rank", chunk_rows=chunk_rows,
    )
    ranked = counted.filter(F.col("_probe").isNull()).select("_group", *folder, order, "_name", "_rank")

    walk_rows = (
        counted.filter(F.col("_probe").isNotNull())
        .select(
            "_group", F.col("_name").alias("_parent"), "_probe.*", F.col("_rank").alias("_before"),
            stem(F.col("_name")).alias("_pstem"), suffix(F.col("_name")).alias("_ext"),
        )
        .withColumn("_tail", F.regexp_extract("_pstem", _ALL_NUMBERS, 2))
        .withColumn("_depth", F.length("_tail") - F.length(F.replace("_tail", F.lit("_"), F.lit(""))))
        .withColumn("_family", F.concat(F.regexp_extract("_pstem", _ALL_NUMBERS, 1), F.lit("/"), "_ext"))
        .repartition("_group", "_family")
        .sortWithinPartitions("_group", "_family", "_depth", "_parent", "_k")
        .select("_group", "_family", "_parent", "_k", "_child", "_before", "_files", "_matters")
    )
    skips = (
        walk_rows.mapInPandas(_walk, "_group string, _name string, _from long")
        .groupBy(*key, "_from")
        .agg(F.count(F.lit(1)).alias("_skips"))
    )

    blank = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in (*folder, order)]
    marks = skips.select("_group", *blank, "_name", F.col("_from").alias("_rank"), "_skips", F.lit(0).alias("_tie"))
    placed = running_total(
        ranked.withColumn("_skips", F.lit(0).cast("long")).withColumn("_tie", F.lit(1)).unionByName(marks),
        key, "_rank", F.col("_skips"), "_shift", tie="_tie", chunk_rows=chunk_rows,
    ).filter(F.col("_tie") == 1)
    return _named(placed, F.col("_rank") + F.col("_shift"), folder, order, name, out)
