"""Fixed word lists, patterns and placeholders, and their DataFrame form.

Every operator takes its lists as arguments; the values here are only the
defaults. Lists too long to be fixed values (a person-name
list, a longer stop list or vocabulary) are parameters: put one word per line in
a file and load it with :func:`read_word_list`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- Fixed values -----------------------------------------------------------
# They must equal the published lists for results to match.

# English stop words of the usual tokeniser corpus.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Words too common in this domain to be informative.
HOTEL_STOPWORDS = """
hotel room stay night day time place location area staff service
people guest customer visitor person man woman guy lady someone
anyone everyone everything something anything nothing
""".split()

NEGATIVE_WORDS = """
bad worst dirty rude expensive slow uncomfortable
noisy cold old poor broken horrible awful smelly
terrible unfriendly small boring disgusting overpriced
""".split()

POSITIVE_WORDS = """
good great clean friendly comfortable excellent amazing
helpful spacious quiet modern nice wonderful perfect
fantastic cozy lovely awesome beautiful affordable
""".split()

# Category -> terms; a token belongs to the first category that lists it.
CATEGORY_TERMS = {
    "accommodation": "accommodation suite apartment villa bedroom bathroom kitchen"
    " balcony pool spa bed amenities".split(),
    "services": "reception concierge housekeeping checkin checkout reservation"
    " parking transportation shuttle".split(),
    "activities": "sightseeing tour excursion museum beach hiking shopping"
    " entertainment nightlife".split(),
    "dining": "restaurant dining breakfast lunch dinner buffet cuisine bar cafe"
    " wine delicious".split(),
    "quality": "comfortable luxury clean spacious friendly professional quality"
    " recommend satisfaction".split(),
    "location": "downtown center nearby view scenery accessibility convenient"
    " central".split(),
    "issues": "problem complaint dirty noisy broken rude slow overpriced"
    " disappointing".split(),
}

# Words of the domain, by topic; a token that is none of them is dropped.
DOMAIN_VOCABULARY = """
accommodation suite apartment villa cottage cabin chalet hostel guesthouse resort
bedroom bathroom kitchen balcony terrace patio garden pool jacuzzi spa
wifi internet television minibar refrigerator airconditioning heating fireplace
bed pillow mattress linen towel amenities toiletries hairdryer safe wardrobe
reception concierge housekeeping maintenance security valet bellhop porter
checkin checkout reservation booking availability upgrade complimentary inclusive
restaurant dining breakfast lunch dinner buffet menu cuisine bar lounge
gym fitness sauna massage wellness relaxation treatment therapy
conference meeting business events wedding banquet catering
parking garage transportation shuttle airport transfer taxi rental
sightseeing tour excursion adventure exploration hiking walking cycling biking
museum gallery exhibition theater cinema entertainment nightlife shopping
beach ocean sea lake river mountain forest park nature landscape
historic cultural heritage architecture monument castle church temple
festival event celebration carnival market fair concert performance
comfortable luxury elegant modern traditional authentic unique spectacular
clean spacious cozy quiet peaceful relaxing convenient accessible
friendly helpful professional courteous attentive responsive efficient
delicious tasty fresh quality variety selection choice option
expensive affordable reasonable value price cost budget cheap
recommend satisfaction experience memorable enjoyable pleasant disappointing
downtown center district neighborhood vicinity nearby walking distance
view scenery panoramic overlooking facing waterfront beachfront hillside
accessibility transportation connection proximity convenience central
problem issue complaint dissatisfied unhappy poor worst terrible
dirty noisy crowded outdated broken damaged faulty
rude unfriendly unprofessional slow delayed cancelled overbooked
overpriced overrated disappointing unacceptable uncomfortable
""".split()

# In matching order: the first city found in the text wins.
CITIES = ["Alexandria", "Sharm El Sheikh", "Luxor", "Aswan", "Hurghada", "Cairo"]

# Texts that mean "nothing was written", compared after cleaning.
SENTIMENT_SENTINELS = ["nothing", "negative feedback", "positive review", "0"]

# Texts never sent to translation, compared lower-case and stripped.
NO_TRANSLATION_NEGATIVE = ["nothing", "negative feedback", "0", "", "na", "n/a"]
NO_TRANSLATION_POSITIVE = ["nothing", "positive review", "0", "", "na", "n/a"]

# Two of these substrings make a text English without asking the detector.
ENGLISH_PATTERNS = [
    "the ", " and ", " was ", " were ", " have ", " this ", " that ",
    " with ", " very ", " good ", " great ", " nice ", " bad ", " hotel ",
    " room ", " staff ", " location ", " service ", " clean ", " breakfast ",
]

# Tokens the word tokeniser splits in two.
CONTRACTIONS = {
    "cannot": "can not", "gimme": "gim me", "gonna": "gon na",
    "gotta": "got ta", "lemme": "lem me", "wanna": "wan na",
}

# Text stored when a review card lacks the field.
CARD_PLACEHOLDERS = {
    "city": "Unknown City",
    "reviewer_name": "No Name",
    "reviewer_nationality": "Unknown Nationality",
    "duration": "No Duration",
    "check_in_date": "No Check-in Date",
    "travel_type": "No Type",
    "room_type": "No Room Type",
    "review_date": "No Date",
    "positive_review": "No Positive Feedback",
    "negative_review": "No Negative Feedback",
}

# Sentiment codes.
BOTH_SIDES, ONLY_NEGATIVE, ONLY_POSITIVE, NO_SIDE = -1, 0, 1, 2
PARITY_LABELS = {1: "Positive", -1: "Negative"}

# Month -> the season label a crawl in that month asks for.
SEASON_BY_QUARTER = {1: "Dec-Feb", 2: "Mar-May", 3: "Jun-Aug", 4: "Sep-Nov"}

# Run presets: hotels per run, pages per hotel (None = no limit).
RUN_PRESETS = {
    "quarterly": (None, None),
    "daily": (10, 5),
    "test": (2, 2),
    "development": (5, 2),
    "testing": (10, 3),
    "production": (50, 5),
}
# --- end of fixed values ----------------------------------------------------

# Our own defaults, where the fixed values contradict themselves.
SENTINELS_EXTENDED = [*SENTIMENT_SENTINELS, "positive feedback"]
LABELS = {
    ONLY_POSITIVE: "Positive",
    ONLY_NEGATIVE: "Negative",
    BOTH_SIDES: "Mixed",
    NO_SIDE: "Empty",
}

#: A word list becomes a literal in the plan; operators join a longer one as a table.
MAX_LITERAL_WORDS = 20_000


def read_word_list(path: str, encoding: str = "utf-8") -> list[str]:
    """One word per line; blank lines and ``#`` comments are skipped."""
    with open(path, encoding=encoding) as lines:
        words = (line.strip().lower() for line in lines)
        return sorted({w for w in words if w and not w.startswith("#")})


def literal_words(words: Iterable[str]) -> list[str]:
    """Check that a list is short enough to travel inside the plan."""
    out = list(dict.fromkeys(words))
    if len(out) > MAX_LITERAL_WORDS:
        raise ValueError(
            f"{len(out)} words do not belong in a plan literal "
            f"(limit {MAX_LITERAL_WORDS}); load them as a table and join"
        )
    return out


def word_frame(spark: SparkSession, words: Iterable[str], name: str = "token") -> DataFrame:
    """The distinct words as a table, however many they are."""
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], f"{name} string")


def category_frame(
    spark: SparkSession, categories: Mapping[str, Iterable[str]] = CATEGORY_TERMS
) -> DataFrame:
    """(token, category, priority); a token keeps only its first category."""
    first: dict[str, tuple[str, int]] = {}
    for priority, (category, terms) in enumerate(categories.items()):
        for term in terms:
            first.setdefault(term.lower(), (category, priority))
    rows = [(token, category, priority) for token, (category, priority) in first.items()]
    return spark.createDataFrame(rows, "token string, category string, priority int")


def words_column(words: Iterable[str]):
    """The list as an ``array<string>`` literal column."""
    return F.array(*[F.lit(w) for w in literal_words(words)]).cast("array<string>")
