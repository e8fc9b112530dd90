"""An order-preserving key for package versions, from built-in expressions only.

Comparing two keys as plain text orders versions as a package manager does: epoch, upstream part, revision;
in each part runs of other characters and numbers alternate, ``~`` sorts before the end of a part, letters
before other characters, numbers by value. One comparator serves every ecosystem, so a leading ``v`` counts
as text. Numbers of up to 999 digits and epochs of up to 12 are supported. The key of null is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = r"([^0-9]+[0-9]*|[0-9]+)"


def _part_key(part: Column) -> Column:
    def piece(p: Column) -> Column:
        text = F.regexp_extract(p, r"^([^0-9]*)", 1)
        text = F.regexp_replace(text, r"([^A-Za-z~])", "7$1")
        text = F.regexp_replace(text, r"([A-Za-z])", "5$1")
        text = F.replace(text, F.lit("~"), F.lit("!!"))
        number = F.regexp_replace(F.regexp_extract(p, r"([0-9]*)$", 1), r"^0+", "")
        return F.concat(text, F.lit("##"), F.lpad(F.length(number).cast("string"), 3, "0"), number)

    filled = F.when(part == "", F.lit("0")).otherwise(part)
    return F.concat(F.array_join(F.transform(F.regexp_extract_all(filled, F.lit(_PIECES), 1), piece), ""), F.lit("##"))


def version_key(version: Column) -> Column:
    epoch = F.regexp_extract(version, r"^([0-9]+):", 1)
    rest = F.regexp_replace(version, r"^[0-9]+:", "")
    upstream = F.regexp_replace(rest, r"-[^-]*$", "")
    revision = F.regexp_extract(rest, r"-([^-]*)$", 1)
    number = F.lpad(F.regexp_replace(F.when(epoch == "", "0").otherwise(epoch), r"^0+(?=.)", ""), 12, "0")
    return F.concat(number, F.lit("|"), _part_key(upstream), F.lit("|"), _part_key(revision))


def _part_sql(x: str) -> str:
    text = "replace(regexp_replace(regexp_replace(regexp_extract(p, '^([^0-9]*)', 1), '([^A-Za-z~])', '7\\1', 'g'), '([A-Za-z])', '5\\1', 'g'), '~', '!!')"
    number = "regexp_replace(regexp_extract(p, '([0-9]*)$', 1), '^0+', '')"
    return f"(array_to_string(list_transform(regexp_extract_all(case when {x} = '' then '0' else {x} end, '([^0-9]+[0-9]*|[0-9]+)', 1), lambda p: {text} || '##' || lpad(cast(length({number}) as varchar), 3, '0') || {number}), '') || '##')"


def version_key_sql(v: str) -> str:
    """The same key in the SQL dialect the tests compare with."""
    rest, epoch = f"regexp_replace({v}, '^[0-9]+:', '')", f"regexp_extract({v}, '^([0-9]+):', 1)"
    number = f"lpad(cast(cast(case when {epoch} = '' then '0' else {epoch} end as bigint) as varchar), 12, '0')"
    upstream, revision = f"regexp_replace({rest}, '-[^-]*$', '')", f"regexp_extract({rest}, '-([^-]*)$', 1)"
    return f"({number} || '|' || {_part_sql(upstream)} || '|' || {_part_sql(revision)})"
