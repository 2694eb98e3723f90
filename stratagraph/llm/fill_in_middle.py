r"""Fill-in-the-middle: texts are cut at two unit bounds and put together again with sentinels, by string functions alone.

Escaped marker injection. A unit is white space with the word behind it, or white space at the end. The text's own escape
and mark characters are escaped, which leaves every unit bound where it is, as all characters used are no white space;
`regexp_replace` puts the mark behind each unit; the marks are counted; `substring_index` takes the units before, between
and behind two ranks; marks are taken out and escapes undone. No text is split into an array, and no Python runs.

Cuts and form come from the digits of a hash of the seed and the id, so a row always gives the same result.

Defined results
- A null text counts as empty. An empty text, and one that holds a sentinel, stays plain.
- A null id hashes as an empty one. Rows of one id and several texts are cut each by its own number of units.
- Repeated rows give the same result each. Ties: two equal cuts give an empty middle.
- Very long texts are taken whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: The mark, the escape, and what stands behind an escape for either of them.
MARK, ESCAPE = "\x02", "\x01"
_FOR_MARK, _FOR_ESCAPE = "m", "e"


def escaped(text: Column) -> Column:
    """text without MARK; `unescaped` undoes it."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + _FOR_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + _FOR_MARK))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + _FOR_MARK), F.lit(MARK)), F.lit(ESCAPE + _FOR_ESCAPE), F.lit(ESCAPE))


def _plain(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(MARK), F.lit("")))


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("long")


def _group(digest: str, k: int) -> Column:
    """The k-th group of 8 hex digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _between(first: str, last: str) -> Column:
    """substring_index with a column as its count."""
    return F.expr(f"substring_index({first}, '{MARK}', cast({last} as int))")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """id_col, n (units), form (plain, psm or spm), prefix, middle, suffix (null where plain), output.

    rate: texts in a hundred that are cut; suffix_first: of those, the ones in a hundred whose suffix comes first (spm).
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), F.sha2(key.cast("binary"), 256).alias("__digest"))
    holds = F.lit(False)
    for s in SENTINELS:
        holds = holds | F.contains("__text", F.lit(s))
    rows = rows.select("*", ((F.col("__text") == "") | holds | (F.pmod(_group("__digest", 2), F.lit(100)) >= rate)).alias("__whole"), F.regexp_replace(escaped(F.col("__text")), UNIT, f"$0{MARK}").alias("__marked"))
    rows = rows.select("*", _count(F.col("__marked"), MARK).alias("__n"))
    cuts = [F.pmod(_group("__digest", k), F.col("__n") + 1) for k in (0, 1)]
    rows = rows.select("*", F.least(*cuts).alias("__a"), F.greatest(*cuts).alias("__b"))
    # The first b units have b - 1 marks between them, so the last b - a parts are the middle; behind the last unit one part more follows.
    rows = rows.select("*", F.when(~F.col("__whole"), _between("__marked", "__a")).alias("__p"), F.when(~F.col("__whole"), _between("__marked", "__b")).alias("__head"), F.when(~F.col("__whole"), _between("__marked", "__b - __n - 1")).alias("__s"))
    rows = rows.select("__id", "__text", "__whole", "__n", "__digest", _plain(F.col("__p")).alias("prefix"), _plain(_between("__head", "__a - __b")).alias("middle"), _plain(F.col("__s")).alias("suffix"))
    form = F.when(F.col("__whole"), "plain").when(F.pmod(_group("__digest", 3), F.lit(100)) < suffix_first, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("__whole"), F.col("__text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return rows.select(F.col("__id").alias(id_col), F.col("__n").alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text, from output and form alone. No sentinel stands within a part, so the first of each kind is the one that was put there."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    middle = F.substring_index(out, MIDDLE, -1)
    head = F.substring_index(out, MIDDLE, 1)
    after, before = (lambda s: F.substring_index(head, s, -1)), (lambda s: F.substring_index(head, s, 1))
    psm = F.concat(F.replace(before(SUFFIX), F.lit(PREFIX), F.lit("")), middle, after(SUFFIX))
    spm = F.concat(after(PREFIX), middle, F.replace(before(PREFIX), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "plain", out).when(form == "spm", spm).otherwise(psm)
