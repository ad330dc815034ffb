"""English stems by the published Snowball (Porter 2) rules, as a chain of column expressions.

Runs on a table of distinct tokens; every step is a handful of regular expressions, so the work
stays in the JVM and each token of a corpus is stemmed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import computed_once

# Irregular words, and words left alone after the plural is gone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_PREFIXES = ["gener", "commun", "arsen"]
# Suffix -> replacement, if the suffix lies in the first region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
# Suffixes that go if they lie in the second region.
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = f"(^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$"


def _table(items: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def _longest(word: Column, suffixes) -> Column:
    """The longest of the suffixes the word ends with, or an empty string."""
    return F.regexp_extract(word, f"(?:{'|'.join(suffixes)})$", 0)


def _region(word: Column, start: Column) -> Column:
    """Where the region after the first vowel and consonant from ``start`` on begins."""
    head = F.regexp_extract(F.substring(word, start + 1, F.length(word)), f"^.*?{VOWEL}{OTHER}", 0)
    return F.when(head == "", F.length(word)).otherwise(start + F.length(head))


class _Steps:
    """A table of tokens with the current form ``w``; every change is evaluated once per row."""

    def __init__(self, tokens: DataFrame):
        self.df = tokens

    def add(self, name: str, value: Column) -> None:
        self.df = computed_once(self.df, name, value)

    def replace_suffix(self, suffixes, decide) -> None:
        """``decide(suffix, stem)`` gives the new ending (NULL keeps the word)."""
        self.add("suffix", _longest(F.col("w"), suffixes))
        stem = F.substring(F.col("w"), F.lit(1), F.length("w") - F.length("suffix"))
        self.add("stem", stem)
        ending = F.when(F.col("suffix") != "", decide(F.col("suffix"), F.col("stem")))
        self.add("w", F.when(F.col("done"), F.col("w")).otherwise(
            F.coalesce(F.concat("stem", ending), F.col("w"))))


def english_stems(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``stem`` to a table of tokens (best: distinct ones)."""
    kept = tokens.columns
    steps = _Steps(tokens)
    steps.add("lower", F.regexp_replace(F.lower(token), "[’‘‛]", "'"))
    w = F.regexp_replace("lower", "^'", "")
    w = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")
    steps.add("w", w)
    steps.add("done", F.coalesce(F.length("lower") <= 2, F.lit(False)))

    prefix = F.regexp_extract("w", f"^(?:{'|'.join(LONG_PREFIXES)})", 0)
    steps.add("r1", F.when(prefix != "", F.length(prefix)).otherwise(_region(F.col("w"), F.lit(0))))
    steps.add("r2", _region(F.col("w"), F.col("r1")))
    in_r1, in_r2 = F.length("stem") >= F.col("r1"), F.length("stem") >= F.col("r2")

    steps.replace_suffix(["'", "'s", "'s'"], lambda s, stem: F.lit(""))
    steps.replace_suffix(
        ["sses", "ied", "ies", "us", "ss", "s"],
        lambda s, stem: F.when(s == "sses", "ss")
        .when(s.isin("ied", "ies"), F.when(F.length(stem) > 1, "i").otherwise("ie"))
        .when((s == "s") & stem.rlike(f"{VOWEL}.+$"), ""),
    )
    steps.add("done", F.col("done") | F.col("w").isin(FINISHED))

    def past(s: Column, stem: Column) -> Column:
        completed = (
            F.when(stem.rlike("(at|bl|iz)$"), "e")
            .when((F.length(stem) <= F.col("r1")) & stem.rlike(SHORT_END), "e")
            .otherwise("")
        )
        return F.when(s.isin("eed", "eedly"), F.when(in_r1, "ee")).when(stem.rlike(VOWEL), completed)

    steps.add("before", F.col("w"))
    steps.replace_suffix(["eed", "eedly", "ed", "edly", "ing", "ingly"], past)
    shortened = (F.col("w") == F.col("stem")) & (F.col("w") != F.col("before"))
    doubled = F.col("w").rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
    steps.add("w", F.when(shortened & doubled, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")))
    steps.replace_suffix(["y", "Y"], lambda s, stem: F.when(stem.rlike(f".{OTHER}$"), "i"))

    steps.replace_suffix(
        SECOND,
        lambda s, stem: F.when(in_r1 & F.when(s == "ogi", stem.endswith("l"))
                               .when(s == "li", stem.rlike("[cdeghkmnrt]$")).otherwise(True),
                               F.element_at(_table(SECOND), s)),
    )
    steps.replace_suffix(
        THIRD,
        lambda s, stem: F.when(in_r1 & ((s != "ative") | in_r2), F.element_at(_table(THIRD), s)),
    )
    steps.replace_suffix(
        FOURTH, lambda s, stem: F.when(in_r2 & ((s != "ion") | stem.rlike("[st]$")), ""))
    steps.replace_suffix(
        ["e", "l"],
        lambda s, stem: F.when((s == "e") & (in_r2 | (in_r1 & ~stem.rlike(SHORT_END))), "")
        .when((s == "l") & in_r2 & stem.endswith("l"), ""),
    )
    irregular = F.element_at(_table(IRREGULAR), F.col("lower"))
    regular = F.when(F.length("lower") <= 2, F.col("lower")).otherwise(F.replace("w", F.lit("Y"), F.lit("y")))
    return steps.df.select(*kept, F.coalesce(irregular, regular).alias("stem"))
