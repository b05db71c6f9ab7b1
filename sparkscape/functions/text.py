"""Text functions as Column expressions; all stay in the JVM.

Null texts give null (or empty arrays where an array is returned); empty and very long
texts need no special care.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"[\p{L}\p{Nl}\p{No}_]"
TOKEN = rf"({LETTERS}{{3,}})"

# Common function words of the corpus languages, our own short list; pass another to replace it.
STOP_WORDS = tuple(
    "about after all and are before but can for from has have her his into its not now only our out over say she that the their them then there they this was were what when where which while who with you your "
    "antes como con cuando del desde donde ella ellas esa ese eso esta este esto hay las los más mientras nadie ninguna ningún para pero por porque que quien sin sobre solo son una uno veces "
    "aber als auf aus bei bevor das dass dem den der des die ein eine einen etwas für ist keine kommt mit nicht nur oder sich und von was wenn wir wurde zwischen "
    "avant avec aux car dans depuis des elle est les mais nous par pas pour que qui sans seul ses son sur une".split()
)

# Phrases that declare opposition, in Spanish and English.
OPPOSITION_MARKERS = (
    "no estoy de acuerdo", "en desacuerdo", "discrepo", "discrepa",
    "incorrecto", "es falso", "eso es falso", "es mentira",
    "al contrario", "por el contrario", "sin embargo", "pero",
    "aunque", "a pesar de", "no obstante", "contradice", "niega",
    "refuta", "rechaza", "se opone", "opuesto a", "contrario a",
    "i disagree", "disagree", "that's wrong", "that is wrong",
    "incorrect", "false", "not true", "on the contrary",
    "however", "but", "although", "despite", "contradicts",
    "refutes", "opposes", "opposite", "against", "unlike",
    "wrong", "misleading", "no evidence", "debunked",
)

# Behaviour nodes and the phrases that show them.
BEHAVIOUR = {
    "silence": ["op_silence", "silence", "silent"],
    "wait": ["wait", "waiting", "hold on", "stand by", "standby"],
    "hold": ["hold", "holding", "pause", "pausing"],
    "pending": ["pending", "not yet", "not ready", "hasn't"],
    "signal": ["signal", "signaling", "op_ready", "op_standby", "ready", "mark ready"],
    "channel": ["channel", "the channel", "broadcast"],
    "map": ["map", "mapping", "tension map", "publish my map"],
    "tension": ["tension", "conflict", "divergence", "structural tension"],
    "repeat": ["repeat", "repeated", "identical", "verbatim", "same message", "already said", "again"],
}


def nfc(text: Column) -> Column:
    """Unicode form NFC, by the ICU library that Spark ships; ASCII texts are passed through."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))).otherwise(text)


def normalize(text: Column) -> Column:
    """NFC, then lower case."""
    return F.lower(nfc(text))


def tokens(text: Column) -> Column:
    """Longest runs of at least three letters, letter-like numbers and underscores, in order."""
    return F.coalesce(F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def without(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def ngrams(words: Column, most: int) -> Column:
    """The words, then their contiguous n-grams for n = 2..most, joined by one space."""
    if most < 2:
        return words

    def grams(w: Column, n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    # Bound as a lambda variable, so that the words are computed once.
    return F.transform(F.array(words), lambda w: F.concat(w, *(grams(w, n) for n in range(2, most + 1))))[0]


def not_blank(text: Column) -> Column:
    return text.rlike(r"[^ \t\r\n]")


def analyze(text: Column, stop: tuple[str, ...] = STOP_WORDS, most: int = 1) -> Column:
    """Normalize, tokenize, drop stop words, add n-grams: the one path for building and evaluating."""
    return ngrams(without(tokens(text), stop), most)


def whole_words(text: Column, phrases) -> Column:
    """Whether a phrase occurs in a normalized text with no word character at either end."""
    escaped = "|".join(p.replace("'", "['’]").replace(".", r"\.") for p in sorted(phrases, key=len, reverse=True))
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({escaped})([^\p{{L}}\p{{N}}_]|$)")


def opposes(text: Column) -> Column:
    """Whether a text carries an opposition marker as whole words; null texts don't."""
    return F.coalesce(whole_words(normalize(text), OPPOSITION_MARKERS), F.lit(False))


def is_prose(line: Column, least: int = 40, heading: int = 80, bullet: int = 60) -> Column:
    """Of a cleaned line: long enough, no table bar, no numbered heading or loose bullet (long ones are prose), at least half letters."""
    letters, n = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(line)
    numbered, listed = line.rlike(r"^\d+(\.\d+)*[.)]?\s+\S") & (n < heading), line.rlike(r"^[-•*]\s") & (n < bullet)
    return (n >= least) & ~line.contains("|") & ~numbered & ~listed & (letters * 2 >= n)


def cleaned(line: Column) -> Column:
    """Without *, backtick and #, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[*`#]", ""), r"\s+", " "))


def set_hash(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), "\n"), 256)


def entities_decoded(df, column: str):
    """The rows with character entities (named and numbered, as HTML has them) of a text column decoded; null stays null."""
    import html

    import pyarrow as pa

    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            texts = pa.array([html.unescape(t) if t and "&" in t else t for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
