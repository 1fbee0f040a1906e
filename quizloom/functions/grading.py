"""Answer grading: normal forms, numeral folding, similarity and the verdict ladder, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions.text import collapse_spaces, fold_accents

ARTICLES = ["the", "a", "an"]
# Words that say what kind of thing an answer is, not which one.
GENERIC = [
    "empire", "kingdom", "dynasty", "republic", "confederacy", "federation", "war", "battle", "siege", "treaty", "act", "amendment", "doctrine", "plan",
    "city", "town", "river", "mountain", "mount", "sea", "ocean", "lake", "island", "president", "king", "queen", "emperor", "empress", "tsar", "czar",
    "sultan", "pharaoh", "general", "admiral", "prime", "minister", "chancellor", "pope", "saint", "st", "sir", "lord", "dr", "mr", "mrs", "states",
    "state", "province", "movement", "revolution", "period", "era", "age", "dispute", "crisis", "of", "and", "or", "de", "la", "le", "el", "von", "van",
]
# Number words, cardinal and ordinal, from 1 to 20.
_CARDINALS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty",
]
_ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth",
    "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def normalize_response(text: Column, full: bool = True) -> Column:
    """Lower case without accents or punctuation, and without a leading article unless that is all."""
    plain = collapse_spaces(F.regexp_replace(F.lower(fold_accents(text, full)), r"[^\p{L}\p{N}\s]", " "))
    return F.regexp_replace(plain, r"^(?:the|an|a) (?=.)", "")


def roman_value(token: Column) -> Column:
    """The value of a canonical roman numeral in lower case, else null."""
    # Subtractive pairs become single letters, so that values simply add up.
    letters = F.split(F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(token, F.lit("cm"), F.lit("1")), F.lit("cd"), F.lit("2")), F.lit("xc"), F.lit("3")), F.lit("xl"), F.lit("4")), F.lit("ix"), F.lit("5")), F.lit("iv"), F.lit("6")), "")
    values = F.create_map(*[F.lit(x) for pair in {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1, "1": 900, "2": 400, "3": 90, "4": 40, "5": 9, "6": 4}.items() for x in pair])
    total = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(values, c), F.lit(0)))
    return F.when(token.rlike(ROMAN) & (token != ""), total)


def tokenize_answer(text: Column, full: bool = True) -> Column:
    """Words of an answer with numerals folded: 14th, fourteenth and a trailing or capital XIV are all 14; articles are left out.

    Capitals are looked up by the word itself, not by its place, which an article dropped from the front would shift.
    """
    numbers = F.create_map(*[F.lit(x) for names in (_CARDINALS, _ORDINALS) for k, w in enumerate(names, 1) for x in (w, str(k))])

    def folded(both: Column) -> Column:
        plain, originals = both["plain"], both["originals"]
        capitals = F.transform(F.filter(originals, lambda w: (w == F.upper(w)) & w.rlike(r"\p{L}")), F.lower)
        n = F.size(plain)

        def fold(token: Column, i: Column) -> Column:
            numeral = F.array_contains(capitals, token) | ((i == n - 1) & (n > 1))
            ordinal = F.regexp_extract(token, "^([0-9]+)(?:st|nd|rd|th)$", 1)
            return (
                F.when(ordinal != "", ordinal)
                .when(F.try_element_at(numbers, token).isNotNull(), F.try_element_at(numbers, token))
                .when(numeral & roman_value(token).isNotNull(), roman_value(token).cast("string"))
                .otherwise(token)
            )

        return F.filter(F.transform(plain, fold), lambda t: (t != "") & ~t.isin(ARTICLES))

    # Folding may need Python, which no lambda may hold: the one-element array binds its results to names.
    both = F.struct(F.split(normalize_response(text, full), " ").alias("plain"), F.split(F.regexp_replace(fold_accents(text, full), r"[^\p{L}\p{N}]+", " "), " ").alias("originals"))
    return F.get(F.transform(F.array(both), folded), F.lit(0))


def distinctive(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(GENERIC))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_matches(needle: Column, tokens: Column) -> Column:
    """A token among others: equal, or for words of five letters and more, nearly so."""
    near = ~needle.rlike("^[0-9]+$") & (F.length(needle) >= 5) & F.exists(tokens, lambda t: (F.length(t) >= 4) & (similarity(needle, t) >= 0.82))
    return F.array_contains(tokens, needle) | near


def leading_subsequence(said: Column, required: Column) -> Column:
    """Whether the said tokens are the required ones in order from the first, with none but words left out."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, token: Column) -> Column:
        here = (s["at"] < F.size(said)) & token_matches(token, F.array(F.coalesce(F.get(said, s["at"]), F.lit(""))))
        return F.struct(F.when(here, s["at"] + 1).otherwise(s["at"]).alias("at"), (s["ok"] & (here | ~token.rlike("^[0-9]+$"))).alias("ok"))

    end = F.aggregate(required, start, step)
    first = token_matches(F.get(required, F.lit(0)), F.array(F.get(said, F.lit(0))))
    return F.coalesce((F.size(said) > 0) & (F.size(required) > 0) & first & end["ok"] & (end["at"] == F.size(said)), F.lit(False))


def judge_candidate(said_norm: Column, said: Column, answer_norm: Column, answer: Column) -> Column:
    """struct(rank, shared, close, reason) for one accepted answer, from its normal form and tokens.

    rank: 0 exact, 1 matched on its distinctive words, 2 contained, 3 its leading part, 4 none of these, 5 a number disagrees.
    """
    required, said_key = distinctive(answer), distinctive(said)
    numbers = lambda tokens: F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))
    conflict = (F.size(numbers(answer)) > 0) & (F.size(numbers(said)) > 0) & (F.size(F.array_except(numbers(answer), numbers(said))) > 0)
    rank = (
        F.when(said_norm == answer_norm, 0)
        .when(conflict, 5)
        .when(F.forall(required, lambda t: token_matches(t, said)), 1)
        .when(F.forall(answer, lambda t: token_matches(t, said)), 2)
        .when(leading_subsequence(said_key, required), 3)
        .otherwise(4)
    )
    reason = F.when(rank == 0, "exact match").when(rank == 1, F.concat(F.lit("matched on "), F.array_join(required, " + "))).when(rank == 2, "answer contained").when(rank == 3, "leading part of the answer")
    return F.struct(
        rank.alias("rank"), F.exists(required, lambda t: token_matches(t, said)).alias("shared"),
        similarity(F.array_join(said_key, " "), F.array_join(required, " ")).alias("close"), reason.alias("reason"),
    )
