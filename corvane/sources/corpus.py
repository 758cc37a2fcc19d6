"""Corpora: delimited files, rich text, versioned indexes with a live pointer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_tags
from ..shared import unused


def read_delimited(spark: SparkSession, path: str, schema: str, tags: list[str] = (), sep: str = ",", tag_sep: str = r"\|") -> DataFrame:
    """A file with a header; cells of `tags` become arrays, empty texts null."""
    rows = spark.read.csv(path, header=True, schema=schema, sep=sep, multiLine=True, escape='"')
    return rows.withColumns({t: split_tags(F.col(t), tag_sep) for t in tags}) if tags else rows


def read_index(spark: SparkSession, path: str, schema: str, id_col: str, nullable: list[str] = ()) -> DataFrame:
    """A tab-separated index with a header: rows with a blank id are skipped, blank cells of `nullable` are null."""
    rows = spark.read.csv(path, header=True, schema=schema, sep="\t", quote="")
    rows = rows.where(F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) != "")
    return rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in nullable}) if nullable else rows


def texts_of_fields(fields: Column, kinds: Column, rich: str = "rich_text") -> Column:
    """The texts of a map of fields, in the order of their names and joined by blanks: those whose kind in the map kinds is
    `rich` as block trees, the others as they are; blank ones are left out."""
    names = F.array_sort(F.map_keys(fields))
    is_rich = lambda n: F.coalesce(F.element_at(kinds, n) == rich, F.lit(False))
    # one tree holds the rich fields, one list the plain ones: the Python function is called once a row
    tree = F.to_json(F.transform(names, lambda n: F.struct(F.when(is_rich(n), F.element_at(fields, n)).alias("rich"), F.when(~is_rich(n), F.element_at(fields, n)).alias("plain"))))

    @F.pandas_udf("string")
    def joined(values: pd.Series) -> pd.Series:
        def walk(node, out):
            if isinstance(node, list):
                for x in node:
                    walk(x, out)
            elif isinstance(node, dict):
                if isinstance(node.get("text"), str):
                    out.append(node["text"])
                walk(node.get("children", []), out)
                if node.get("url"):
                    out.append(f"({node['url']})")

        def one(value):
            parts = []
            for f in json.loads(value):
                own: list[str] = []
                if "rich" in f:
                    try:
                        tree = json.loads(f["rich"])
                        tree = json.loads(tree) if isinstance(tree, str) and tree[:1] in ("[", "{") else tree
                    except ValueError:
                        tree = f["rich"]
                    own.append(tree) if isinstance(tree, str) else walk(tree, own)
                else:
                    own.append(f.get("plain") or "")
                parts.append(" ".join(" ".join(own).replace("\xa0", " ").split()))
            return " ".join(p for p in parts if p)

        return values.map(one, na_action="ignore")

    return joined(tree)


def text_of_blocks(content: Column) -> Column:
    """Text of a JSON block tree (string-encoded or not): leaves joined by spaces, links followed by (url)."""

    def walk(node, out):
        if isinstance(node, list):
            for x in node:
                walk(x, out)
        elif isinstance(node, dict):
            if isinstance(node.get("text"), str):
                out.append(node["text"])
            walk(node.get("children", []), out)
            if node.get("url"):
                out.append(f"({node['url']})")

    def text(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            tree = json.loads(value)
            tree = json.loads(tree) if isinstance(tree, str) and tree[:1] in "[{" else tree
        except ValueError:
            tree = value
        if isinstance(tree, str):
            return tree
        out: list[str] = []
        walk(tree, out)
        return " ".join(" ".join(out).replace("\xa0", " ").split())

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(text, na_action="ignore")

    return of(content)


def latest_keys(metadata: Column) -> Column:
    """A map with keys base-N: of each base the value of the highest N (no number: -1, ties to the first)."""
    entries = F.transform(F.map_entries(metadata), lambda e, i: F.struct(
        F.regexp_replace(e["key"], r"-[0-9]+$", "").alias("base"), F.coalesce(F.nullif(F.regexp_extract(e["key"], r"-([0-9]+)$", 1), F.lit("")).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("n"), e["value"].alias("value"), i.alias("at")))
    best = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["base"] == e["base"]) & ((o["n"] > e["n"]) | ((o["n"] == e["n"]) & (o["at"] < e["at"])))))
    return F.map_from_entries(F.transform(best, lambda e: F.struct(e["base"], e["value"])))


def body_table(rows: DataFrame, key: str, body: str, order: list[str]) -> DataFrame:
    """(key, body): the last body of each key that is not blank."""
    full = rows.where(F.coalesce(F.trim(body), F.lit("")) != "")
    return full.groupBy(key).agg(F.max_by(body, F.struct(*order)).alias(body))


def layered(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """One row per key from layers of equal columns: that of the last layer that has it."""
    out, at = None, unused(layers[0], "layer")
    for i, layer in enumerate(layers):
        one = layer.withColumn(at, F.lit(i))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in layers[0].columns if c not in key]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias(at)).select(*key, f"{at}.*")


def build(rows: DataFrame, metadata: DataFrame, key: str, order: list[str], fields: list[str], default: str = "all") -> DataFrame:
    """The first row of each key with its metadata; blank or missing fields become the default."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return first.join(metadata, key, "left").withColumns({f: F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit(default)) for f in fields})


def piped(text: Column) -> Column:
    """A comma list as a pipe list: trimmed, blanks dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), "|")
