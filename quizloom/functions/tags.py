"""Category suggestions from keywords."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The terms that speak for each category, as substrings of the lower-cased text.
RULES: dict[str, tuple[str, ...]] = {
    "US History": ("united states", "american", "america", "congress", "president", "washington", "lincoln", "jefferson", "confederate", "union army", "colonies", "yankee", "u.s.", "new york", "california", "virginia", "roosevelt", "white house"),
    "European History": ("europe", "france", "french", "britain", "british", "england", "english", "germany", "german", "spain", "spanish", "italy", "italian", "russia", "russian", "poland", "prussia", "habsburg", "papal", "scandinav", "dutch"),
    "Asian History": ("china", "chinese", "japan", "japanese", "korea", "india", "indian", "mongol", "vietnam", "dynasty of", "shogun", "samurai", "mughal", "silk road"),
    "African History": ("africa", "african", "egypt", "mali", "songhai", "ghana", "ethiopia", "zulu", "swahili", "carthage", "nile"),
    "Latin American History": ("mexico", "mexican", "brazil", "argentina", "peru", "aztec", "inca", "maya", "bolivar", "latin america", "caribbean", "cuba"),
    "Middle Eastern History": ("ottoman", "persia", "iran", "iraq", "israel", "arab", "mesopotamia", "babylon", "assyria", "sumer", "islamic caliphate", "baghdad", "jerusalem"),
    "Ancient World": ("ancient", "rome", "roman", "greece", "greek", "athens", "sparta", "pharaoh", "mesopotamia", "sumer", "babylon", "b.c.", "bce", "hellenistic", "punic"),
    "Middle Ages": ("medieval", "middle ages", "feudal", "crusade", "knight", "byzantine", "charlemagne", "viking", "norman", "magna carta", "black death"),
    "Renaissance": ("renaissance", "medici", "michelangelo", "leonardo da vinci", "humanis"),
    "Exploration": ("explorer", "voyage", "columbus", "magellan", "circumnavigat", "conquistador", "new world", "expedition", "cartograph"),
    "Revolutions": ("revolution", "revolt", "uprising", "rebellion", "bastille", "jacobin", "bolshevik", "independence movement"),
    "World Wars": ("world war", "wwi", "wwii", "ww1", "ww2", "nazi", "hitler", "pearl harbor", "d-day", "holocaust", "trench", "blitz", "allied powers", "axis powers", "treaty of versailles"),
    "Empires": ("empire", "imperial", "colony", "colonial", "emperor", "empress", "caliphate"),
    "Leaders": ("president", "king", "queen", "emperor", "empress", "prime minister", "chancellor", "dictator", "pharaoh", "sultan", "tsar", "czar", "general"),
    "Religions": ("church", "christian", "catholic", "protestant", "islam", "muslim", "buddhis", "hindu", "jewish", "judaism", "pope", "monk", "temple", "prophet", "bible", "quran", "reformation"),
    "Art History": ("painting", "painter", "sculpture", "artist", "fresco", "portrait", "impressionis", "baroque", "architect", "cathedral", "mural"),
    "Sports History": ("olympic", "world cup", "baseball", "football", "boxing", "athlete"),
    "Literature History": ("novel", "poet", "poem", "playwright", "shakespeare", "author", "wrote the book", "epic", "literature"),
    "Science History": ("scientist", "physicist", "chemist", "biologist", "invention", "inventor", "telescope", "vaccine", "discovered the element", "theory of", "astronom"),
    "Military History": ("battle", "siege", "army", "navy", "regiment", "cavalry", "artillery", "campaign", "war ", "soldier", "fleet", "musket", "infantry"),
    "Economic History": ("trade", "tariff", "economy", "economic", "depression", "bank", "currency", "merchant", "industrial", "labor union", "stock market"),
    "Mythology": ("myth", "god of", "goddess", "zeus", "odin", "norse", "olympus", "titan", "legend of", "deity", "pantheon"),
    "Historical Geography": ("river", "mountain", "strait", "peninsula", "island", "capital city", "border", "territory", "canal"),
    "Politics": ("election", "parliament", "senate", "constitution", "treaty", "law", "supreme court", "party", "vote", "amendment", "diplomat"),
    "Social Movements": ("suffrage", "civil rights", "abolition", "slavery", "protest", "strike", "feminis", "segregation", "boycott"),
    "Technology": ("railroad", "steam engine", "telegraph", "printing press", "automobile", "computer", "aircraft", "engine", "factory"),
}
# Years that place a text in an era, the first that matches; and the names of all eras.
ERA_YEARS = [(r"1[0-4]\d\d", "Middle Ages"), (r"1[5-7]\d\d", "Early Modern"), (r"18\d\d", "Modern"), (r"19[0-4]\d", "Modern"), (r"(?:19[5-9]\d|20\d\d)", "Contemporary")]
ERAS = ["Ancient World", "Middle Ages", "Renaissance", "Early Modern", "Modern", "Contemporary"]
DEFAULT_TAG, MOST_TAGS = "World History", 5


_held: list = []


def _automaton():
    """One automaton of the terms of all rules, made once a worker; each term has the places of its rules."""
    if not _held:
        import ahocorasick

        rules: dict[str, list[int]] = {}
        for n, terms in enumerate(RULES.values()):
            for t in set(terms):
                rules.setdefault(t, []).append(n)
        made = ahocorasick.Automaton()
        for k, (t, places) in enumerate(rules.items()):
            made.add_word(t, (k, places))
        made.make_automaton()
        _held.append(made)
    return _held[0]


@F.arrow_udf(T.ArrayType(T.StringType()))
def matched_tags(texts: pa.Array) -> pa.Array:
    """The tags of lower-cased texts, up to MOST_TAGS: by how many of their terms occur, then by name. One pass over each text, whatever the number of terms."""
    found, names = _automaton(), list(RULES)
    out = []
    for text in texts.to_pylist():
        hits: dict[int, int] = {}
        for _, places in dict(value for _, value in found.iter(text)).items() if text else ():
            for n in places:
                hits[n] = hits.get(n, 0) + 1
        out.append([name for _, name in sorted((-h, names[n]) for n, h in hits.items())[:MOST_TAGS]])
    return pa.array(out, pa.list_(pa.string()))


def suggest_tags(text: Column, answer: Column | None = None) -> Column:
    """Up to five categories: by how many of their terms occur, then by name; then an era by years; else the default.

    Terms are found in Arrow batches by one automaton; the years and the choice are built-in functions.
    """
    hay = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(answer, F.lit("")) if answer is not None else F.lit("")))
    era = F.lit(None).cast("string")
    for years, name in reversed(ERA_YEARS):
        era = F.when(hay.rlike(rf"\b{years}\b"), name).otherwise(era)

    def finished(both: Column) -> Column:
        found, era = both["found"], both["era"]
        with_era = F.when(~F.arrays_overlap(found, F.array(*map(F.lit, ERAS))) & era.isNotNull(), F.concat(found, F.array(era))).otherwise(found)
        return F.slice(F.when(F.size(with_era) == 0, F.array(F.lit(DEFAULT_TAG))).otherwise(with_era), 1, MOST_TAGS)

    # A one-element array binds what was found to a name, so that it is computed once.
    return F.get(F.transform(F.array(F.struct(matched_tags(hay).alias("found"), era.alias("era"))), finished), F.lit(0))
