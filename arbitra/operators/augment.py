"""Contrastive augmentation: fresh rows whose framing fixes their label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ordering import seeded_int
from arbitra.operators.inputs import parse_fields, serialize_fields
from arbitra.operators.ranks import hash_rank

# The serialised tags in order, and the texts the framings use.
EMAIL_TAGS = ("from", "sender", "subject", "link_text", "link_url", "body")
NEGATION_FILLERS = (
    "This is not a drill and not tomorrow but today.",
    "Do not wait and do not hesitate.",
    "This cannot stay unresolved and must not be ignored.",
    "Never ignore this notice.",
    "Do not brush this off.",
)
ADVISORY_SENDERS = (
    ("IT Security", "security@company.com"),
    ("IT Helpdesk", "helpdesk@company.com"),
    ("Comms", "comms@company.com"),
    ("HR", "hr@company.com"),
    ("Finance", "finance@company.com"),
    ("Facilities", "facilities@company.com"),
)
ADVISORY_FRAMES = (
    (
        "Security notice: scam pattern",
        "The IT desk warns that messages like the quoted one below are scams. "
        "Do not follow their links and do not send anything. Quoted scam: ",
    ),
    (
        "Fraud alert: ignore this pattern",
        "Fraudulent emails of the following kind are going around. They are not from us. "
        "Delete them and never use their links. Quoted fraud: ",
    ),
    (
        "Reminder: we never ask this way",
        "A reminder that we never contact you this way. Anything phrased like the quoted text "
        "below is a trap. Do not engage with it. Quoted trap: ",
    ),
)
CANCEL_PAIRS = (
    ("is scheduled for", "is cancelled and will not take place"),
    ("will happen tomorrow", "will not happen; it is called off"),
    ("is available now", "is no longer available"),
    ("arrives Friday", "will not arrive Friday"),
    ("is open", "is closed until further notice"),
    ("is required", "is not required"),
)
CANCELLED = " This is now cancelled and will not happen."
# The published sets quote so many characters of a body and take CAP rows of a class.
# Both are options; by default whole bodies of all rows are used.
QUOTE_CHARS, DRESS_CHARS, CANCEL_CHARS, CAP = 400, 350, 450, 120


def _head(body: Column | str, chars: int | None) -> Column:
    c = F.col(body) if isinstance(body, str) else body
    return c if chars is None else F.substring(c, 1, chars)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _base(df: DataFrame, id_col: str, label_col: str, label: str, cap: int | None, seed: int) -> DataFrame:
    mine = df.filter(F.col(label_col) == label)
    return hash_rank(mine, [id_col], seed, rank="_rank", limit=cap)


def _parsed(df: DataFrame, text: str) -> DataFrame:
    """The serialised fields; a text without tags is all body."""
    defaults: Mapping[str, str] = {
        "from": "a@b.c", "sender": "s", "subject": "Notice", "link_text": "", "link_url": "", "body": None,
    }
    return parse_fields(df.select("*"), text, EMAIL_TAGS, defaults).withColumn("body", F.coalesce("body", text))


def _emit(df: DataFrame, id_col: str, label: str, kind: str, **fields: Column) -> DataFrame:
    parts = [(tag, fields[tag]) for tag in EMAIL_TAGS]
    out = serialize_fields(df.withColumn("_src", F.col(id_col)), parts, "_out")
    return out.select(
        F.col("_src").alias(id_col), F.col("_out").alias("input"), F.lit(label).alias("label"), F.lit(kind).alias("kind")
    )


def aug_advisory(
    df: DataFrame, id_col: str, text: str, label_col: str = "label", cap: int | None = None, seed: int = 11,
    source: str = "phishing", target: str = "legitimate", chars: int | None = None,
) -> DataFrame:
    """Quote a harmful body under a warning notice: the result is legitimate.
    Senders rotate with the rank, so no sender gives the label away."""
    d = _parsed(_base(df, id_col, label_col, source, cap, seed), text)
    frame = F.pmod(seeded_int(f"{seed}:frame", id_col), F.lit(len(ADVISORY_FRAMES))).cast("int")
    sender = F.pmod(F.col("_rank") - 1, F.lit(len(ADVISORY_SENDERS))).cast("int")
    return _emit(
        d, id_col, target, "advisory",
        **{
            "from": F.get(_strings([a for _, a in ADVISORY_SENDERS]), sender),
            "sender": F.get(_strings([n for n, _ in ADVISORY_SENDERS]), sender),
            "subject": F.get(_strings([s for s, _ in ADVISORY_FRAMES]), frame),
            "link_text": F.lit(""),
            "link_url": F.lit(""),
            "body": F.concat(F.get(_strings([t for _, t in ADVISORY_FRAMES]), frame), _head("body", chars)),
        },
    )


def aug_negation(
    df: DataFrame, id_col: str, text: str, label_col: str = "label", cap: int | None = None, seed: int = 11,
    source: str = "phishing", chars: int | None = None,
) -> DataFrame:
    """Put two different filler sentences before the body; the label stays."""
    d = _parsed(_base(df, id_col, label_col, source, cap, seed), text)
    k = len(NEGATION_FILLERS)
    first = F.pmod(seeded_int(f"{seed}:first", id_col), F.lit(k)).cast("int")
    step = F.pmod(seeded_int(f"{seed}:second", id_col), F.lit(k - 1)).cast("int")
    second = F.pmod(first + 1 + step, F.lit(k)).cast("int")
    fillers = _strings(NEGATION_FILLERS)
    dressed = F.concat_ws(" ", F.get(fillers, first), F.get(fillers, second), _head("body", chars))
    return _emit(
        d, id_col, source, "negation",
        **{
            "from": F.col("from"), "sender": F.col("sender"), "subject": F.col("subject"),
            "link_text": F.lit(""), "link_url": F.col("link_url"), "body": dressed,
        },
    )


def cancelled(body: Column, chars: int | None = None, whole: int | None = None) -> Column:
    """Replace the first known phrase, in any case, by its cancelled form; without one, say
    so in a closing sentence after ``chars`` characters. ``whole`` bounds the result."""
    low = F.lower(body)
    out = F.concat(F.lit("Update: "), _head(body, chars), F.lit(CANCELLED))
    for phrase, flipped in reversed(CANCEL_PAIRS):
        at = F.locate(phrase.lower(), low)
        swapped = F.concat(
            F.substring(body, F.lit(1), at - 1),
            F.lit(flipped),
            F.substring(body, at + F.lit(len(phrase)), F.length(body)),
        )
        out = F.when(at > 0, swapped).otherwise(out)
    return _head(out, whole)


def aug_cancel(
    df: DataFrame, id_col: str, text: str, label_col: str = "label", cap: int | None = None, seed: int = 11,
    source: str = "legitimate", chars: int | None = None, whole: int | None = None,
) -> DataFrame:
    """Flip the polarity of harmless notices; the label stays."""
    d = _parsed(_base(df, id_col, label_col, source, cap, seed), text)
    subject = F.when(F.contains(F.col(text), F.lit("subject: ")), F.col("subject")).otherwise(F.lit("notice"))
    return _emit(
        d, id_col, source, "cancel",
        **{
            "from": F.col("from"), "sender": F.col("sender"), "subject": F.concat(F.lit("Update: "), subject),
            "link_text": F.lit(""), "link_url": F.lit(""), "body": cancelled(F.col("body"), chars, whole),
        },
    )


def augment(df: DataFrame, id_col: str, text: str, label_col: str = "label", cap: int | None = None, seed: int = 11) -> DataFrame:
    """All three framings of one base table."""
    return (
        aug_advisory(df, id_col, text, label_col, cap, seed)
        .unionByName(aug_negation(df, id_col, text, label_col, cap, seed))
        .unionByName(aug_cancel(df, id_col, text, label_col, cap, seed))
    )
