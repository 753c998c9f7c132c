"""Text normalisation as Catalyst expressions; none of them runs Python on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All characters that count as white space (by rule: those that Python's str.isspace() names).
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def trimmed(c: Column) -> Column:
    """Without white space (any Unicode one) at either end. Most cells have none but plain spaces, and begin and end in printable ASCII."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"(?s)^(?:[!-~](?:.*[!-~])?)?\z"), text).otherwise(F.btrim(text, F.lit(SPACES)))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def none_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tidy(c: Column) -> Column:
    """Trimmed, lower case, single spaces; null if nothing is left."""
    return none_if_blank(squeezed(F.lower(trimmed(c))))


def title_case(c: Column) -> Column:
    """A capital after every character that is not a letter: `o'neil 10l` gives `O'Neil 10L` (initcap looks at spaces only, which
    is enough where a text has but spaces between ASCII letters)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.when(c.rlike(r"^[A-Za-z ]*\z"), F.initcap(c)).otherwise(F.array_join(F.transform(runs, lambda run: F.initcap(run)), ""))


def looked_up(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value, or the column's own where it has none."""
    if not table:
        return c
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def letters_for_digits(c: Column, table: Mapping[str, str]) -> Column:
    """Look-alike characters back to letters, in lower case, word by word: a character of the table is replaced where its left
    neighbour (as already replaced) or its right one is a letter. Words that begin or end with a digit stay (sizes, versions)."""
    table = {k.strip(): v.strip() for k, v in table.items() if len(k.strip()) == 1 and len(v.strip()) == 1}
    if not table:
        return F.lower(c)
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def word(w: Column) -> Column:
        def step(state: Column, char: Column) -> Column:
            left = F.right(state["done"], F.lit(1)).rlike(r"\p{L}")
            right = F.substr(w, state["at"] + 1, F.lit(1)).rlike(r"\p{L}")
            new = F.when(left | right, F.coalesce(F.try_element_at(pairs, char), char)).otherwise(char)
            return F.struct(F.concat(state["done"], new).alias("done"), (state["at"] + 1).alias("at"))

        start = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))
        folded = F.aggregate(F.split(w, ""), start, step, lambda s: s["done"])
        return F.when((w == "") | w.rlike(r"^\p{Nd}|\p{Nd}$"), w).otherwise(folded)

    return F.array_join(F.transform(F.split(F.lower(c), " "), word), " ")


def joined_flags(flags: Sequence[tuple[str, Column]]) -> Column:
    """The names of the flags that hold, in order, with `|` between them; null if none does."""
    return none_if_blank(F.concat_ws("|", *[F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in flags]))


def truthy(c: Column) -> Column:
    """1 for true, t, yes, y and 1 in any case, else 0."""
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "t", "yes", "y"), F.lit(False)).cast("int")
