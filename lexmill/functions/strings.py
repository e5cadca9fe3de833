"""Token-level string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: \\w of Unicode text, as a class that Java and RE2 share.
W = r"\p{L}\p{N}_"
PUNCT = r"[^\p{L}\p{N}_\s]"
TOKENS = rf"[{W}]+|{PUNCT}"
EDGES = r"""[.,!?;:"'()]"""


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def clean_token(word: Column) -> Column:
    """Lower-cased, with everything but letters cut off at both ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_with_punctuation(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def detokenize(tokens: Column) -> Column:
    """Tokens in a line, without a space before single punctuation characters."""
    joined = F.transform(tokens, lambda t, i: F.when((i == 0) | t.rlike(rf"^{PUNCT}$"), t).otherwise(F.concat(F.lit(" "), t)))
    return F.array_join(joined, "")


def edge_clean(token: Column) -> Column:
    """Lower-cased, with everything but word characters cut off at both ends."""
    return F.lower(F.regexp_replace(token, rf"^[^{W}]+|[^{W}]+$", ""))


def edge_prefix(token: Column) -> Column:
    return F.regexp_extract(token, f"^({EDGES}*)", 1)


def edge_suffix(token: Column) -> Column:
    return F.regexp_extract(token, f"({EDGES}*)$", 1)


def bare(token: Column) -> Column:
    """Lower-cased word characters only."""
    return F.lower(F.regexp_replace(token, rf"[^{W}]", ""))


def restore_case(original: Column, corrected: Column) -> Column:
    """Capitalised if the original begins with an upper-case letter."""
    upper = F.substring(original, 1, 1).rlike(r"\p{Lu}")
    capital = F.concat(F.upper(F.substring(corrected, 1, 1)), F.lower(corrected.substr(F.lit(2), F.length(corrected))))
    return F.when(upper, capital).otherwise(corrected)


def deletes(word: Column) -> Column:
    """All strings with one character less, each once; none for an empty word."""
    n = F.length(word)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n)))
    return F.when(n > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def edits1(word: Column, alphabet: str = LETTERS) -> Column:
    """All strings one deletion, swap of neighbours, replacement or insertion away, each once; they may hold the word itself."""
    n = F.length(word)
    letters = F.split(F.lit(" ".join(alphabet)), " ")
    to = lambda i: word.substr(F.lit(1), i)
    after = lambda i: word.substr(i + 1, n)
    none = F.array().cast("array<string>")
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    gaps = F.sequence(F.lit(0), n)
    replaced = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(to(i - 1), c, after(i)))))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(letters, lambda c: F.concat(to(i), c, after(i)))))
    swapped = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(to(i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), after(i + 1)))
    return F.array_distinct(F.concat(deletes(word), F.when(n > 1, swapped).otherwise(none), F.when(n > 0, replaced).otherwise(none), inserted))


def is_edit1(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    distance = F.levenshtein(a, b)
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, n)) == b)
    return (distance == 1) | ((distance == 2) & (n == F.length(b)) & (n > 1) & swap)


def hashed(key: Column, of: Column | int) -> Column:
    """A number below ``of`` from the md5 of a key."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), of if isinstance(of, Column) else F.lit(of))


def random_edit(word: Column, seed: Column) -> Column:
    """One edit of the word, drawn from md5 of word and seed: delete, insert, substitute or swap; only insert and substitute for words under two characters."""
    key = F.concat_ws(":", word, seed.cast("string"))
    draw = lambda what, of: hashed(F.concat(key, F.lit(what)), of)
    n = F.length(word)
    op = F.when(n >= 2, draw(":op", 4)).otherwise(draw(":op", 2) + 1)
    at = draw(":at", F.greatest(n, F.lit(1)))
    gap = draw(":at", n + 1)
    left = draw(":at", F.greatest(n - 1, F.lit(1)))
    letter = F.substring(F.lit(LETTERS), 1, 26).substr((draw(":c", 26) + 1).cast("int"), F.lit(1))
    cut = lambda a: word.substr(F.lit(1), a.cast("int"))
    rest = lambda a: word.substr((a + 1).cast("int"), n)
    swapped = F.concat(cut(left), word.substr((left + 2).cast("int"), F.lit(1)), word.substr((left + 1).cast("int"), F.lit(1)), rest(left + 2))
    return F.when(op == 0, F.concat(cut(at), rest(at + 1))).when(op == 1, F.concat(cut(gap), letter, rest(gap))).when(op == 2, F.concat(cut(at), letter, rest(at + 1))).otherwise(swapped)


def merge_typing(tokens: Column, key: Column, per_mille: int = 80) -> Column:
    """Tokens with some neighbouring pairs of A-Z words run together: fast typing. The draw of place i is md5 of (key, i)."""
    plain = "^[A-Za-z]+$"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

    def step(acc: Column, x: Column) -> Column:
        follows = F.get(tokens, x["i"] + 1)
        drawn = hashed(F.concat_ws(":", key.cast("string"), x["i"].cast("string")), 1000) < per_mille
        merges = F.coalesce(drawn & x["t"].rlike(plain) & follows.rlike(plain), F.lit(False))
        word = F.when(merges, F.concat(x["t"], follows)).otherwise(x["t"])
        kept = F.struct(F.concat(acc["out"], F.array(word)).alias("out"), merges.alias("skip"))
        return F.when(acc["skip"], F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))).otherwise(kept)

    indexed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.aggregate(indexed, start, step, lambda acc: acc["out"])
