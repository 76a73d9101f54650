"""Lookups in short sorted arrays (histogram knots, bucket bounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skymap.functions.staging import as_sql, compute


def with_count_below(
    df: DataFrame, arr: str, key: str, longest: int, out: str, inclusive: bool = True
) -> DataFrame:
    """Add how many elements of an ascending array are <= key (or < key).

    Binary descent over fixed powers of two, one generated-code step each: about
    log2(longest) comparisons per row and no range join. ``longest`` is the known
    upper bound of the array size; a longer array fails the job.
    """
    a, k = as_sql(arr), as_sql(key)
    longest = max(1, longest)
    sign = "<=" if inclusive else "<"
    steps = {"from": f"CASE WHEN size({a}) > {longest} THEN CAST(raise_error('array longer than {longest}') AS INT) ELSE 0 END"}
    last = ":from"
    for bit in reversed(range(longest.bit_length())):
        name = f"at{bit}"
        steps[name] = (
            f"CASE WHEN get({a}, {last} + {(1 << bit) - 1}) {sign} {k} THEN {last} + {1 << bit} ELSE {last} END"
        )
        last = f":{name}"
    return compute(df, steps, {out: last})
