"""robots.txt: records, the rules for an agent, and what they allow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(text: str) -> list[tuple[str, str]]:
    """(key in lower case, value) of each line; comments and lines without a colon are left out."""
    out = []
    for line in re.split("\r\n|\r|\n", text):
        key, colon, value = line.split("#", 1)[0].partition(":")
        if colon and key.strip():
            out.append((key.strip().lower(), value.strip()))
    return out


def rules(text: str, agent: str) -> list[tuple[str, bool]]:
    """(prefix, allowed) for an agent, in order of (prefix, allowed first).

    A record counts if one of its User-agent lines is * or the agent's name, in any case; each such line clears
    what came before, so the last matching record holds.  An empty Disallow allows all.
    """
    out: list[tuple[str, bool]] = []
    inside = False
    starting = False
    for key, value in records(text):
        if key == "user-agent":
            if not starting:
                inside, starting = False, True
            if value == "*" or value.lower() == agent.lower():
                inside, out = True, []
            continue
        starting = False
        if inside and key in ("allow", "disallow"):
            if value:
                out.append((value, key == "allow"))
            elif key == "disallow":
                out.append(("", True))
    return sorted(set(out), key=lambda r: (r[0], not r[1]))


def allowed(text: str, agent: str, path: str) -> bool:
    """The last rule that is a prefix of the path decides: the longest one, and a ban where two are equal."""
    found = True
    for prefix, ok in rules(text, agent):
        if path.startswith(prefix):
            found = ok
    return found


def match_rules(pages: DataFrame, path: Column, rule_table: DataFrame, on: list[str]) -> DataFrame:
    """Append `allowed` by rules (prefix, ok) kept as data, joined on a key such as the host; without rules all is allowed.

    A key's rules, as few as a robots file has, go to its pages as one array, longest first and bans before the
    rest; the first that is a prefix decides.  Pages are rows of their own, alike or not, and none is grouped.
    """
    one = F.struct((-F.length("prefix")).alias("back"), F.col("ok"), F.col("prefix"))
    own = rule_table.groupBy(*on).agg(F.array_sort(F.collect_list(one)).alias("__rules"))
    joined = pages.withColumn("__path", path).join(own, on, "left")
    hit = F.try_element_at(F.filter("__rules", lambda r: F.startswith("__path", r["prefix"])), F.lit(1))
    return joined.select(*pages.columns, F.coalesce(hit["ok"], F.lit(True)).alias("allowed"))
