"""Weak labels, relabelling, cold start and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import augment as A
from arbitra.operators import rules as R
from arbitra.operators.inputs import serialize_fields
from arbitra.plans.base import documents, hex_int_sql, labelled, query, rounded, table


def _quoted(s: str) -> str:
    return s.replace("'", "''")


@query("flag_lure", f"SELECT page_id, regexp_matches(html, '(?i){_quoted(R.LURE)}') AS lure FROM pages")
def q_flag_lure(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.flag_lure("html").alias("lure"))


@query("flag_urgency", f"SELECT o_orderkey, regexp_matches(o_orderpriority || ' ' || o_orderstatus, '(?i){_quoted(R.URGENCY)}') AS urgency FROM orders")
def q_flag_urgency(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", R.flag_urgency(R.joined_text("o_orderpriority", "o_orderstatus")).alias("urgency")
    )


_DOMAINS = ["Gmail.com", "example.org", "yahoo.com", "corp.example.net", "mail.com"]
_SENDER_SQL = (
    "CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE c_name || '@' || ['" + "', '".join(_DOMAINS) + "'][c_nationkey % 5 + 1] END"
)


def _customers(spark, sf):
    c = table(spark, sf, "customer")
    domain = F.get(F.array(*[F.lit(d) for d in _DOMAINS]), (F.col("c_nationkey") % 5).cast("int"))
    sender = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@"), domain))
    return c.withColumn("sender", sender)


_WEBMAIL_SQL = ", ".join(f"'{d}'" for d in R.WEBMAIL)


@query(
    "flag_webmail",
    f"SELECT c_custkey, CASE WHEN contains(s, '@') THEN lower(split_part(s, '@', 2)) IN ({_WEBMAIL_SQL}) ELSE false END AS webmail FROM (SELECT c_custkey, {_SENDER_SQL} AS s FROM customer)",
)
def q_flag_webmail(spark, sf):
    return _customers(spark, sf).select("c_custkey", R.flag_webmail("sender").alias("webmail"))


_HOST = "lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query("link_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def q_link_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.link_host("url").alias("host"))


@query("flag_hosting", f"SELECT page_id, h = 'example.org' OR h LIKE '%.example.org' OR h = 'blog.tionsh.example.net' AS hosting FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def q_flag_hosting(spark, sf):
    hosts = ["example.org", "blog.tionsh.example.net"]
    return table(spark, sf, "pages").select("page_id", R.flag_hosting("url", hosts).alias("hosting"))


_SITE = "array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"


@query(
    "flag_mismatch",
    f"SELECT page_id, {_SITE.format(h='h')} <> CASE WHEN page_id % 2 = 0 THEN 'example.org' ELSE 'example.net' END AS mismatch FROM (SELECT page_id, {_HOST} AS h FROM pages)",
)
def q_flag_mismatch(spark, sf):
    sender = F.when(F.col("page_id") % 2 == 0, F.lit("a@Mail.example.org")).otherwise(F.lit("b@example.net"))
    return table(spark, sf, "pages").select("page_id", R.flag_mismatch(sender, "url").alias("mismatch"))


@query(
    "match_label",
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ering') THEN 'ERING' WHEN contains(lower(text), 'the') THEN 'The' WHEN contains(lower(text), 'le') THEN 'le' END AS label FROM conversations",
)
def q_match_label(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.match_label("text", ["ERING", "The", "le"]).alias("label"))


@query("strip_prefix", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def q_strip_prefix(spark, sf):
    c = table(spark, sf, "conversations").withColumn("t", F.concat(F.lit("phase hunt "), "text"))
    return c.select("conv_id", "turn", F.md5(R.strip_prefix("t", r"phase \w+ ").cast("binary")).alias("digest"))


_TEACHER = "teacher AS (SELECT doc_id, CASE WHEN n_chars >= 500 THEN 'good' ELSE 'poor' END AS taught FROM documents WHERE doc_id % 3 <> 0)"
_RELABEL = (
    f"WITH {_TEACHER}, l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS old FROM labels), "
    "j AS (SELECT doc_id, old, taught FROM l LEFT JOIN teacher USING (doc_id)) "
)


def _relabelled(spark, sf):
    teacher = documents(spark, sf).filter(F.col("doc_id") % 3 != 0)
    teacher = teacher.select("doc_id", F.when(F.col("n_chars") >= 500, "good").otherwise("poor").alias("label"))
    return R.relabel(labelled(spark, sf).select("doc_id", F.col("truth").alias("label")), teacher, "doc_id")


@query("relabel", _RELABEL + "SELECT doc_id, coalesce(taught, old) AS label FROM j")
def q_relabel(spark, sf):
    return _relabelled(spark, sf).select("doc_id", "label")


@query("agreement_rate", _RELABEL + "SELECT count(taught) AS n, round(avg(CAST(taught = old AS DOUBLE)), 6) AS teacher_agreement FROM j")
def q_agreement_rate(spark, sf):
    return rounded(R.agreement_rate(_relabelled(spark, sf)), "teacher_agreement")


@query("cold_start")
def q_cold_start(spark, sf):
    d = documents(spark, sf)
    teacher = d.select("doc_id", F.concat(F.lit("Type: "), F.upper("lang")).alias("reply"))
    return R.cold_start(d, teacher, "doc_id", "text", ["en", "de", "fr", "es"])["gate"]


# E-mails made from the documents: the toxic label plays the harmful class.
_BODY_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'The gate is open. ' ELSE '' END || text"
_MAIL = (
    "mail AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'phishing' ELSE 'legitimate' END AS label, source || '@' || lang || '.example.com' AS frm, source AS snd, "
    f"'Doc ' || doc_id AS subj, 'http://' || lang || '.example.com/' || doc_id AS url, {_BODY_SQL} AS body FROM documents JOIN labels USING (doc_id))"
)


def mails(spark, sf):
    """(doc_id, label, input): serialised e-mails."""
    d = labelled(spark, sf)
    lead = F.when(F.col("doc_id") % 2 == 0, F.lit("The gate is open. ")).otherwise(F.lit(""))
    fields = [
        ("from", F.concat("source", F.lit("@"), "lang", F.lit(".example.com"))),
        ("sender", F.col("source")),
        ("subject", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))),
        ("link_text", F.lit("")),
        ("link_url", F.concat(F.lit("http://"), "lang", F.lit(".example.com/"), F.col("doc_id").cast("string"))),
        ("body", F.concat(lead, "text")),
    ]
    d = d.withColumn("label", F.when(F.col("toxic") == 1, "phishing").otherwise("legitimate"))
    return serialize_fields(d, fields, "input").select("doc_id", "label", "input")


def _list(values) -> str:
    return "[" + ", ".join(f"'{_quoted(v)}'" for v in values) + "]"


def _ranked(label: str, seed: int = 11) -> str:
    return (
        f"base AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) AS r FROM mail WHERE label = '{label}'))"
    )


def _mail_text(frm, snd, subj, link_url, body):
    return f"'from: ' || {frm} || ' sender: ' || {snd} || ' subject: ' || {subj} || ' link_text: ' || ' link_url: ' || {link_url} || ' body: ' || {body}"


def _draw(tag: str, k: int) -> str:
    return f"{hex_int_sql(f'''md5('11:{tag}:' || doc_id)''')} % {k}"


_ADVISORY = (
    f"WITH {_MAIL}, {_ranked('phishing')}, f AS (SELECT *, {_list([t for _, t in A.ADVISORY_FRAMES])}[{_draw('frame', 3)} + 1] AS frame, "
    f"{_list([s for s, _ in A.ADVISORY_FRAMES])}[{_draw('frame', 3)} + 1] AS ns, {_list([a for _, a in A.ADVISORY_SENDERS])}[(r - 1) % 6 + 1] AS nf, "
    f"{_list([n for n, _ in A.ADVISORY_SENDERS])}[(r - 1) % 6 + 1] AS nn FROM base) "
    f"SELECT doc_id, 'legitimate' AS label, 'advisory' AS kind, {_mail_text('nf', 'nn', 'ns', chr(39) * 2, 'frame || body')} AS input FROM f"
)


@query("aug_advisory", _ADVISORY)
def q_aug_advisory(spark, sf):
    return A.aug_advisory(mails(spark, sf), "doc_id", "input")


_FILL = _list(A.NEGATION_FILLERS)
_NEGATION = (
    f"WITH {_MAIL}, {_ranked('phishing')}, f AS (SELECT *, {_draw('first', 5)} AS a, {_draw('second', 4)} AS b FROM base) "
    f"SELECT doc_id, 'phishing' AS label, 'negation' AS kind, "
    f"{_mail_text('frm', 'snd', 'subj', 'url', f'{_FILL}[a + 1] || chr(32) || {_FILL}[(a + 1 + b) % 5 + 1] || chr(32) || body')} AS input FROM f"
)


@query("aug_negation", _NEGATION)
def q_aug_negation(spark, sf):
    return A.aug_negation(mails(spark, sf), "doc_id", "input")


_CANCEL = (
    f"WITH {_MAIL}, {_ranked('legitimate')} SELECT doc_id, 'legitimate' AS label, 'cancel' AS kind, "
    + _mail_text(
        "frm", "snd", "'Update: ' || subj", "''",
        "CASE WHEN doc_id % 2 = 0 THEN 'The gate is closed until further notice. ' || text ELSE 'Update: ' || body || ' This is now cancelled and will not happen.' END",
    )
    + " AS input FROM base JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"
)


@query("aug_cancel", _CANCEL)
def q_aug_cancel(spark, sf):
    return A.aug_cancel(mails(spark, sf), "doc_id", "input")
