"""Weak labels by rule, relabelling and cold start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the lure and the urgency flag.
LURE = (
    r"sign.?in|log.?in|verif|confirm.*account|account.*(locked|suspend|hold)|"
    r"open.*document|download|claim.*(prize|refund|reward)|invoice.*(pay|due|overdue)|"
    r"password.*reset|reset.*password|update.*(payment|billing|card)|claim now|"
    r"gift.?card|pay.*fee|submit.*detail"
)
URGENCY = (
    r"\burgent|immediately|asap|deadline|expir\w*\s*(today|soon|within)|within\s*24|"
    r"last chance|act now|threat|suspend|locked|lose access|final notice|"
    r"do not (wait|delay|hesitate|ignore)|today only|not later|at once|right away"
)
# Free mail domains.
WEBMAIL = (
    "gmail.com outlook.com hotmail.com yahoo.com aol.com proton.me protonmail.com icloud.com live.com msn.com "
    "ymail.com gmx.com mail.com zoho.com yandex.com"
).split()
# Own choice: well-known free hosts and link shorteners.
FREE_HOSTS = (
    "bit.ly tinyurl.com t.co goo.gl is.gd ow.ly cutt.ly rebrand.ly buff.ly web.app firebaseapp.com github.io "
    "netlify.app vercel.app pages.dev weebly.com wixsite.com blogspot.com wordpress.com sites.google.com"
).split()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_text(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(_c(p), F.lit("")) for p in parts])


def flag_lure(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(f"(?i){LURE}"), F.lit(False))


def flag_urgency(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(f"(?i){URGENCY}"), F.lit(False))


def sender_domain(sender: Column | str) -> Column:
    """Lowercased part after the last ``@``; empty without one."""
    s = F.coalesce(_c(sender), F.lit(""))
    return F.when(F.contains(s, F.lit("@")), F.lower(F.substring_index(s, "@", -1))).otherwise(F.lit(""))


def flag_webmail(sender: Column | str, domains: Sequence[str] = tuple(WEBMAIL)) -> Column:
    return sender_domain(sender).isin(list(domains))


def link_host(url: Column | str) -> Column:
    """Lowercased host of a link without its port; empty when there is none."""
    return F.lower(F.coalesce(F.try_parse_url(F.trim(_c(url)), F.lit("HOST")), F.lit("")))


def under_domain(host: Column, domain: Column) -> Column:
    """Whether ``host`` is the domain or lies below it."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def flag_hosting(url: Column | str, hosts: Sequence[str] = tuple(FREE_HOSTS)) -> Column:
    """Whether a link goes to a free host or a shortener."""
    host = link_host(url)
    listed = F.array(*[F.lit(h) for h in hosts])
    return F.exists(listed, lambda h: under_domain(host, h))


def site_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def flag_mismatch(sender: Column | str, url: Column | str) -> Column:
    """Whether sender and link are both present and on different sites."""
    a, b = sender_domain(sender), link_host(url)
    return (a != "") & (b != "") & (site_domain(a) != site_domain(b))


def signal_flags(sender: Column | str, text: Column | str, url: Column | str) -> dict[str, Column]:
    """The five rule signals of a message."""
    return {
        "free_hosting": flag_hosting(url),
        "domain_mismatch": flag_mismatch(sender, url),
        "lure": flag_lure(text),
        "urgency": flag_urgency(text),
        "generic_sender": flag_webmail(sender),
    }


def match_label(reply: Column | str, labels: Sequence[str]) -> Column:
    """First label, in list order, that a free reply contains, ignoring case;
    null when none."""
    low = F.lower(_c(reply))
    return F.coalesce(*[F.when(F.contains(low, F.lit(label.lower())), F.lit(label)) for label in labels])


def strip_prefix(text: Column | str, pattern: str) -> Column:
    """Drop a leading phrase, such as a phase marker."""
    return F.regexp_replace(_c(text), f"^(?:{pattern})", "")


def relabel(df: DataFrame, teacher: DataFrame, id_col: str, label: str = "label", teacher_label: str = "label") -> DataFrame:
    """Take the teacher's label where it has one; ``agree`` compares it with the
    old one."""
    t = teacher.select(id_col, F.col(teacher_label).alias("_t"))
    return (
        df.join(t, id_col, "left")
        .withColumn("agree", F.when(F.col("_t").isNotNull(), F.col("_t") == F.col(label)))
        .withColumn(label, F.coalesce("_t", label))
        .drop("_t")
    )


def agreement_rate(relabelled: DataFrame) -> DataFrame:
    return relabelled.agg(
        F.count("agree").alias("n"), F.coalesce(F.avg(F.col("agree").cast("double")), F.lit(0.0)).alias("teacher_agreement")
    )


def cold_start(
    corpus: DataFrame,
    teacher: DataFrame,
    id_col: str,
    text_col: str,
    labels: Sequence[str],
    n: int = 120,
    target: float = 0.80,
    seed: int = 20260921,
    train_share: float = 0.75,
    review: int = 12,
    **options,
) -> dict:
    """Start a question without labels of its own.

    Sample ``n`` rows, map the teacher's replies (``id``, ``reply``) to labels,
    train on a seeded share and pass when the held-out rows repeat the
    teacher's labels at ``target``. Returns the labelled rows, the rows to
    review, the calibrated model and a one-row gate table.
    """
    from arbitra.operators.calibrate import calibrate
    from arbitra.operators.ranks import hash_rank
    from arbitra.operators.splits import sample_n
    from arbitra.operators.train import model_accuracy, reorder_classes, train_tfidf
    from arbitra.session import written

    sample = sample_n(corpus.select(id_col, text_col), id_col, n, seed)
    replies = teacher.select(id_col, match_label("reply", labels).alias("label"))
    usable = sample.join(replies, id_col).filter(F.col("label").isNotNull())
    labelled = written(hash_rank(usable, [id_col], f"{seed}:split", rank="_r", total="_t"), "cold-start")
    is_train = F.col("_r") <= F.floor(F.col("_t") * F.lit(train_share))
    train, held = (labelled.filter(c).drop("_r", "_t") for c in (is_train, ~is_train))
    model = train_tfidf(train, id_col, text_col, "label", model_id="cold-start", **options)
    if sorted(labels) == sorted(model.classes):
        model = reorder_classes(model, labels)
    fidelity = model_accuracy(model, held, id_col, text_col, "label")
    model = calibrate(model, held, id_col, text_col, "label")
    gate = corpus.sparkSession.createDataFrame(
        [(train.count(), held.count(), fidelity, target, "pass" if fidelity >= target else "hold", model.temperature)],
        "n_train bigint, n_held bigint, fidelity double, target double, gate string, temperature double",
    )
    return {
        "labelled": labelled.drop("_r", "_t"),
        "review": labelled.filter(F.col("_r") <= review).select(id_col, "label", F.col(text_col).alias("text")),
        "model": model,
        "gate": gate,
    }
