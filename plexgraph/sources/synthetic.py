"""Source text made of the driver tables, so that scanners have files to read: a TypeScript or a Python file for each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .projections import read, spread

#: The same paths in SQL; ``k`` is the part's key.
SQL_FILES = """
files AS (SELECT p_partkey AS k, p_size AS s, p_name AS name, p_partkey * 7 % 50 AS o, p_partkey % 10 AS b, CASE WHEN p_partkey % 3 = 0 THEN 'py' ELSE 'ts' END AS language,
  CASE WHEN p_partkey % 11 = 0 THEN 'node_modules/' WHEN p_partkey % 13 = 0 THEN 'pkg/dist/' ELSE 'src/' END || 'm' || p_partkey % 17 || '/p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.py' WHEN p_partkey % 19 = 0 THEN '.min.js' ELSE '.ts' END AS path FROM part)"""

_TS = r"""import { f%(o)s, helper } from './p%(o)s';
/**
 * Part %(name)s.
 */
export function f%(k)s(a, b) {
  if (a > %(s)s && b) { return f%(o)s(a); } // if (not code)
  return fetch('/api/items/%(o)s');
}
export class C%(k)s extends C%(b)s {
  run(x) { return helper(x); }
}
"""
_PY = r'''"""Module of %(name)s."""
import os
from p%(o)s import f
class C%(k)s(C%(b)s):
    """Doc %(k)s."""
    def run(self, x):
        if x and %(s)s:
            return f(x)
        return os.getpid()
'''


def _filled(template: str) -> Column:
    """The template with its places filled from columns."""
    out = []
    rest = template
    while "%(" in rest:
        head, _, tail = rest.partition("%(")
        name, _, rest = tail.partition(")s")
        out += [F.lit(head), F.col(name).cast("string")]
    return F.concat(*out, F.lit(rest))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, language, content) of every part's file; some lie in folders or have names that scans ignore.

    The keys are spread over tasks before texts are made of them, for a table of millions of parts may be one small file.
    """
    k = F.col("k")
    s = lambda c: c.cast("string")
    x = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_name").alias("name"), (F.col("p_partkey") * 7 % 50).alias("o"), (F.col("p_partkey") % 10).alias("b"))
    x = spread(x, "k")
    folder = F.when(k % 11 == 0, "node_modules/").when(k % 13 == 0, "pkg/dist/").otherwise("src/")
    ending = F.when(k % 3 == 0, ".py").when(k % 19 == 0, ".min.js").otherwise(".ts")
    path = F.concat(folder, F.lit("m"), s(k % 17), F.lit("/p"), s(k), ending)
    return x.select("k", path.alias("path"), F.when(k % 3 == 0, "py").otherwise("ts").alias("language"), F.when(k % 3 == 0, _filled(_PY)).otherwise(_filled(_TS)).alias("content"))
