"""One statement, two dialects: ``{name(args)}`` calls in a template become Spark's or DuckDB's spelling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.sources.tables import views

#: name: (Spark, DuckDB); $1, $2 are the arguments
SPELLINGS = {
    "days": ("datediff(cast($2 as date), cast($1 as date))", "(cast($2 as date) - cast($1 as date))"),
    "hash16": ("substr(sha2($1, 256), 1, 16)", "substr(sha256($1), 1, 16)"),
    "hash": ("sha2($1, 256)", "sha256($1)"),
    "nth": ("element_at(sort_array(collect_list($1)), cast(floor(count(*) * $2) as int) + 1)", "list_sort(list($1))[cast(floor(count(*) * $2) as int) + 1]"),
    "text": ("cast($1 as string)", "cast($1 as varchar)"),
    "json": ("cast(get_json_object($1, '$.$2') as bigint)", "cast(json_extract_string($1, '$.$2') as bigint)"),
    "matches": ("rlike($1, $2)", "regexp_matches($1, $2)"),
    "top": ("max_by($1, $2)", "arg_max($1, $2)"),
    "distinct3": ("array_join(slice(sort_array(collect_set($1)), 1, 3), ',')", "array_to_string(list_sort(list_distinct(list($1)))[1:3], ',')"),
    "words": ("filter(split(lower($1), '[^a-z0-9]+'), w -> length(w) >= 2)", "list_filter(regexp_split_to_array(lower($1), '[^a-z0-9]+'), lambda w: length(w) >= 2)"),
    "near": ("levenshtein($1, $2)", "levenshtein($1, $2)"),
    "day": ("cast($1 as date)", "cast($1 as date)"),
}


def spell(template: str, duck: bool) -> str:
    def put(m: re.Match) -> str:
        args = [a.strip() for a in m[2].split("; ")]
        out = SPELLINGS[m[1]][duck]
        for n, a in enumerate(args, 1):
            out = out.replace(f"${n}", a)
        return out

    while True:
        done = re.sub(r"\{(\w+)\(([^{}]*)\)\}", put, template)
        if done == template:
            return done
        template = done


def spark_query(template: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = spell(template, duck=False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    return run
