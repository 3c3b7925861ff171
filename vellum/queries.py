"""Registered queries of the sensitive-text engine, each with its SQL.

Prompts that hold what the text tables lack are built from the relational tables by one SQL expression that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum import oracles as o
from vellum.functions import normalize as norm, validators
from vellum.functions.dialect import sql_string as s
from vellum.operators import lexicon, lexicon_data as data, redact, rules, score
from vellum.plans import policy, scan as plans
from vellum.sources.tables import pages_text, spread, table
from vellum.streaming import events as ev, timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ID = "CAST(c_custkey AS STRING)"
_NUM = f"lpad({_ID}, 9, '0')"
#: A prompt for each customer, sixteen kinds by turns.
PROMPT = f"""CASE c_custkey % 16
 WHEN 0 THEN 'my name is ' || c_name || ' and i live in Cebu City, i am ' || CAST(c_custkey % 90 AS STRING) || ' years old, i have diabetes'
 WHEN 1 THEN 'please call 0917' || lpad({_ID}, 7, '0') || ' or mail cust' || {_ID} || '@shop.example.com about the mortgage'
 WHEN 2 THEN 'my card is 4111 1111 1111 1111 and ' || 'TIN: ' || {_NUM}
 WHEN 3 THEN 'api_key = "sk-proj-abcdefghijkl-' || {_NUM} || '" is the secret'
 WHEN 4 THEN 'i was arrested and my salary is ' || {_ID} || '000, i work at Acme, my birthday is 1990, i have asthma'
 WHEN 5 THEN 'server 10.0.' || CAST(c_custkey % 256 AS STRING) || '.7 and 2001:0db8:0000:0000:0000:ff00:0042:' || lpad(CAST(c_custkey % 9999 AS STRING), 4, '0') || ' with 00:1a:2b:3c:4d:' || lpad(CAST(c_custkey % 99 AS STRING), 2, '0')
 WHEN 6 THEN 'I WAS BORN ON MAY 5 AND MY NAEM IS ' || upper(c_name) || '. ok then'
 WHEN 7 THEN 'Brgy Poblacion, Makati City or Main Street, Quezon City ' || {_ID} || '. thanks!!! see you ,bye'
 WHEN 8 THEN 'I learn ' || CAST(c_custkey % 9 AS STRING) || ' languages daily.and i am a muslim from Davao'
 WHEN 9 THEN 'Name: ' || c_name || ' Age: ' || CAST(c_custkey % 90 AS STRING)
 WHEN 10 THEN 'token eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiI' || {_NUM} || 'In0.abc-_' || {_ID} || ' end'
 WHEN 11 THEN 'I suffer from asthma. Reach +63 917 ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' 4567 or (555) 867-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
 WHEN 12 THEN 'my home address is ' || CAST(c_custkey % 300 AS STRING) || ' Rizal Avenue, Pasig and my acount number is ' || {_NUM}
 WHEN 13 THEN '4111-1111-1111-1111 then 378282246310005 then 1234567890123456 ' || {_NUM}
 WHEN 14 THEN 'nothing to see here, just order ' || c_mktsegment
 ELSE 'I work as a nurse and i wrok for ' || c_name || ' so my income is ' || {_ID} END"""


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(PROMPT).alias("text"))


PROMPTS = f"(SELECT c_custkey AS doc_id, {PROMPT} AS text FROM customer)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- normaliser


def _text_query(name: str, make, sql: str, source=docs, sql_source: str = "documents", spark_text: str = "text", sql_text: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = source(spark, sf_dir).select("doc_id", F.expr(spark_text).alias("text"))
        return make(d)

    QUERIES[name] = run
    ORACLES[name] = sql.format(source=f"(SELECT doc_id, {sql_text} AS text FROM {sql_source})")


def _value(f):
    return lambda d: d.select("doc_id", f(F.col("text")).alias("value"))


def _select(x: str) -> str:
    return f"SELECT doc_id, {x.replace('{', '{{').replace('}', '}}')} AS value FROM {{source}}"


_crlf = "replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(13))"
_text_query("norm_line_endings", _value(norm.line_feeds), _select(o.line_feeds("text")), spark_text=_crlf, sql_text=_crlf)
_blank = "' ' || chr(9) || text || chr(10) || ' '"
_text_query("norm_trim", _value(norm.trim_space), _select(o.trim_space("text")), spark_text=_blank, sql_text=_blank)
_hidden = "replace(text, 'e', 'e​­')"
_text_query("norm_invisible", _value(norm.strip_invisible), _select(o.strip_invisible("text")), spark_text=_hidden, sql_text=_hidden)
_quoted = "'“' || replace(replace(text, ' ', ' '), ',', '—') || '’'"
_text_query("norm_ascii_punct", _value(norm.ascii_punctuation), _select(o.ascii_punctuation("text")), spark_text=_quoted, sql_text=_quoted)
_wide = "translate(text, '0123456789', '０１２３４５６７８９')"
_text_query("norm_compose", _value(norm.compose), "SELECT doc_id, coalesce(text, '') AS value FROM documents", spark_text=_wide)
_text_query("norm_shared_layer", _value(norm.shared_layer), _select(o.shared("text")), spark_text=_blank, sql_text=_blank)
_text_query("norm_upper_ratio", _value(norm.upper_ratio), _select(o.upper_ratio("text")))
_upper = "CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END"
_text_query("norm_caps_guard", _value(norm.caps_fires), _select(o.caps_fires("text")), spark_text=_upper, sql_text=_upper)
_text_query("norm_caps_guard_as_written", _value(lambda c: norm.caps_fires(c, "as_written")), _select(o.caps_fires("text", "as_written")), spark_text=_upper, sql_text=_upper)
_text_query("norm_sentence_case", _value(lambda c: norm.sentence_case(norm.collapse(c))), _select(o.sentence_case(o.collapse("text"))))
_text_query("norm_collapse", _value(norm.collapse), _select(o.collapse("text")))
_text_query("norm_punctuation", _value(lambda c: norm.tidy_punctuation(norm.collapse(c))), _select(o.tidy_punctuation(o.collapse("text"))))
_text_query("norm_boundary", _value(norm.sentence_bounds), _select(o.sentence_bounds("text")))
_text_query("norm_raise_starts", _value(lambda c: norm.raise_starts(norm.collapse(F.lower(c)))), _select(o.raise_starts(o.collapse("lower(text)"))))


@register(f"WITH {o.normalised('documents', 'doc_id')} SELECT doc_id, masked, text_regex, text_nlp, was_caps_converted FROM n")
def normalize_documents(spark, sf_dir):
    return norm.normalize(docs(spark, sf_dir)).select("doc_id", "masked", "text_regex", "text_nlp", "was_caps_converted")


@register(f"WITH {o.normalised(PROMPTS, 'doc_id')} SELECT doc_id, text_regex, text_nlp, was_caps_converted FROM n")
def normalize_prompts(spark, sf_dir):
    return norm.normalize(prompts(spark, sf_dir)).select("doc_id", "text_regex", "text_nlp", "was_caps_converted")


@register(
    "SELECT c_custkey AS doc_id, 'See' || chr(10) || '```' || chr(10) || '  ' || c_name || chr(10) || '```' || chr(10) || 'and `' || c_name || '` now' AS value FROM customer"
)
def norm_regex_layer(spark, sf_dir):
    code = "'See   ```' || chr(10) || '  ' || c_name || chr(10) || '```  and  `' || c_name || '`   now'"
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(code).alias("text"))
    return norm.normalize(d).select("doc_id", F.col("text_regex").alias("value"))


# --- pattern rules

_FINDING = ["pattern_id", "risk", "raw_match", "safe_version", "validated", "ord"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts the rules are for: prompts, documents and turns of conversations."""
    turns = spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))
    parts = [("prompts", prompts(spark, sf_dir)), ("documents", docs(spark, sf_dir)), ("conversations", turns)]
    every = [d.select(F.lit(name).alias("origin"), "doc_id", "text") for name, d in parts]
    return every[0].unionByName(every[1]).unionByName(every[2])


TEXTS = f"(SELECT 'prompts' AS origin, doc_id, text FROM {PROMPTS} UNION ALL SELECT 'documents', doc_id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"
for _rule in rules.RULES:

    def _run(spark, sf_dir, rule=_rule):
        source = texts(spark, sf_dir)
        if rule.id == "source_code":
            source = source.withColumn("text", F.concat(F.lit("run `"), "text", F.lit("` and ```x\ny```")))
        found = rules.rule_findings(F.col("text"), rule, rules.RULES.index(rule))
        return plans.each(source, found, "origin", "doc_id").select("origin", "doc_id", *_FINDING)

    QUERIES[f"det_{_rule.id}"] = _run
    _source = TEXTS
    if _rule.id == "source_code":
        _source = f"(SELECT origin, doc_id, 'run `' || text || '` and ```x' || chr(10) || 'y```' AS text FROM {TEXTS})"
    ORACLES[f"det_{_rule.id}"] = o.rule_rows(_rule, _source, "origin, doc_id", "text")


@register(
    f"SELECT doc_id, m AS raw_match, {', '.join(f'{o.passes(p, chr(109))} AS {p}' for p in validators.PREDICATES)} FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS m FROM {PROMPTS})"
)
def validators_all(spark, sf_dir):
    words = prompts(spark, sf_dir).select("doc_id", F.explode(F.split("text", " ")).alias("raw_match"))
    return words.select("doc_id", "raw_match", *[f(F.col("raw_match")).alias(p) for p, f in validators.PREDICATES.items()])


@register(f"SELECT doc_id, {o.PLACE.format('text')} AS has_place FROM {PROMPTS} UNION ALL SELECT doc_id, {o.PLACE.format('text')} FROM documents")
def place_any(spark, sf_dir):
    return prompts(spark, sf_dir).unionByName(docs(spark, sf_dir)).select("doc_id", validators.has_place(F.col("text")).alias("has_place"))


@register(f"SELECT doc_id, array_to_string(list_filter({o._list(data.PLACES)}, lambda p: contains(lower(text), p)), '|') AS places FROM {PROMPTS}")
def place_list(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", F.array_join(validators.places(F.col("text")), "|").alias("places"))


# --- lexicon

def _found(d: DataFrame, column: str, *keys: str) -> DataFrame:
    return plans.each(d, F.col(column), *keys).select(*keys, *_FINDING)


@register(f"WITH {o.normalised(PROMPTS, 'doc_id')} {o.term_rows('n', 'doc_id')}")
def lex_terms(spark, sf_dir):
    d = norm.normalize(prompts(spark, sf_dir))
    return _found(d.withColumn("found", lexicon.term_findings(F.col("text_nlp"))), "found", "doc_id")


@register(f"WITH {o.normalised(PROMPTS, 'doc_id')} {o.trigger_rows('n', 'doc_id')}")
def lex_triggers(spark, sf_dir):
    return _found(lexicon.with_trigger_findings(norm.normalize(prompts(spark, sf_dir))), "triggers", "doc_id")


@register(
    f"SELECT doc_id, w, p AS phrase, {o.similarity('w', 'p')} AS ratio FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM {PROMPTS}), (VALUES ('i am'), ('i''m'), ('i earn')) AS t(p) WHERE w <> ''"
)
def fuzzy_ratio(spark, sf_dir):
    words = prompts(spark, sf_dir).select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''").distinct()
    phrases = F.explode(F.array(*map(F.lit, ("i am", "i'm", "i earn"))))
    return words.withColumn("phrase", phrases).withColumn("ratio", lexicon.similarity(F.col("w"), F.col("phrase")))


# --- merge, score, policy

_PROMPT_ALL = f"WITH {o.normalised(PROMPTS, 'doc_id')}, f AS ({o.merged(o.all_rows('n', 'doc_id'), 'doc_id')})"
_SCORED = f"{_PROMPT_ALL}, {o.scored('f', 'n', 'doc_id')}"


@register(f"{_PROMPT_ALL} SELECT doc_id, pattern_id, risk, raw_match, safe_version, validated FROM f")
def merge_findings(spark, sf_dir):
    found = _found(plans.findings(prompts(spark, sf_dir)), "findings", "doc_id")
    return found.drop("ord")


@register(f"{_SCORED} SELECT doc_id, base_total, multiplier, score, preliminary, governance, risk_level, n_findings::INT AS n_findings FROM z")
def score_prompts(spark, sf_dir):
    d = plans.scan(prompts(spark, sf_dir))
    return d.select("doc_id", "base_total", "multiplier", "score", "preliminary", "governance", "risk_level", F.size("findings").alias("n_findings"))


def _scan_sql(source: str, keys: str) -> str:
    return f"""WITH {o.normalised(source, keys)}, f AS ({o.merged(o.all_rows('n', keys), keys)}), {o.scored('f', 'n', keys)}
SELECT {keys}, score, risk_level, governance, n_findings::INT AS n_findings, was_caps_converted, risk_level = 'none' AS submit_allowed FROM z"""


def _scan_result(d: DataFrame, *keys: str) -> DataFrame:
    return plans.scan(d).select(*keys, "score", "risk_level", "governance", F.size("findings").alias("n_findings"), "was_caps_converted", "submit_allowed")


@register(_scan_sql("documents", "doc_id"))
def scan_documents(spark, sf_dir):
    return _scan_result(docs(spark, sf_dir), "doc_id")


@register(_scan_sql("conversations", "conv_id, turn"))
def scan_conversations(spark, sf_dir):
    return _scan_result(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), "conv_id", "turn")


_LEGACY_RULES = "\nUNION ALL ".join(o.rule_rows(r, "t", "doc_id", "x") for r in rules.RULES)
_LEGACY_TEXT = o.trim_space(f"regexp_replace(translate(coalesce(text, ''), '‘’“”–—', '''''\"\"--'), {s('[' + norm.SPACES.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'f' + chr(92) + 'r') + ']+')}, ' ', 'g')")


@register(
    f"WITH t AS (SELECT doc_id, {_LEGACY_TEXT} AS x FROM documents), f AS ({o.merged(_LEGACY_RULES, 'doc_id', 'raw_match')}) "
    f"SELECT t.doc_id, ['none', 'low', 'moderate', 'high'][1 + coalesce(max({o.rank('risk')}), 0)] AS risk_level, count(risk)::INT AS n_findings FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id"
)
def legacy_risk(spark, sf_dir):
    return plans.legacy_scan(docs(spark, sf_dir)).select("doc_id", "risk_level", F.size("findings").alias("n_findings"))


@register(
    f"""{_PROMPT_ALL}, l AS (SELECT doc_id, list({{'m': raw_match, 'v': safe_version}} ORDER BY length(raw_match) DESC, ord) AS fs FROM f WHERE raw_match <> '' GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN fs IS NULL THEN n.text ELSE list_reduce(list_prepend({{'m': n.text, 'v': ''}}, fs), lambda a, x: {{'m': replace(a.m, x.m, x.v), 'v': ''}}).m END AS safe_text FROM n LEFT JOIN l USING (doc_id)"""
)
def redact_prompts(spark, sf_dir):
    return plans.scan(prompts(spark, sf_dir)).select("doc_id", "safe_text")


_MAIL = rules.BY_ID["email"]


@register(
    f"SELECT doc_id, list_reduce(list_prepend(text, list_sort(list_distinct(regexp_extract_all(text, {s(o.re2(_MAIL.pattern))})))), lambda a, m: replace(a, m, left(m, 1) || '***@' || split_part(m, '@', 2))) AS safe_text FROM {PROMPTS}"
)
def redact_emails(spark, sf_dir):
    d = prompts(spark, sf_dir).withColumn("f", rules.rule_findings(F.col("text"), _MAIL))
    return d.select("doc_id", redact.safe_text(F.col("text"), F.col("f")).alias("safe_text"))


_text_query("truncate_display", _value(redact.truncate), "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS value FROM documents")


@register("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS value FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact.escape_html(F.col("html")).alias("value"))


@register(
    "SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages"
)
def source_pages(spark, sf_dir):
    return pages_text(table(spark, sf_dir, "pages")).select("page_id", "text")


@register(
    f"{_SCORED}, pr(risk_level, label, badge, show_bar, clickable, show_safe, n_actions) AS (VALUES {', '.join(f'({s(r[0])}, {s(r[1])}, {s(r[2])}, {str(r[4]).lower()}, {str(r[5]).lower()}, {str(r[6]).lower()}, {len(r[7])})' for r in policy.PRESENTATION)}) "
    "SELECT doc_id, risk_level, label, badge, show_bar, clickable, show_safe, n_actions, n_findings::VARCHAR || CASE WHEN n_findings = 1 THEN ' sensitive item' ELSE ' sensitive items' END AS bar_text, risk_level = 'none' AS submit_allowed FROM z JOIN pr USING (risk_level)"
)
def risk_presentation(spark, sf_dir):
    d = plans.scan(prompts(spark, sf_dir)).select("doc_id", "risk_level", F.size("findings").alias("n"), "submit_allowed")
    d = d.withColumn("p", policy.presented(F.col("risk_level")))
    shown = [f"p.{c}" for c in ("label", "badge", "show_bar", "clickable", "show_safe")]
    return d.select("doc_id", "risk_level", *shown, F.size("p.actions").alias("n_actions"), policy.bar_text(F.col("n")).alias("bar_text"), "submit_allowed")


_KINDS = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in policy.KINDS.items())


@register(f"{_PROMPT_ALL} SELECT CASE pattern_id {_KINDS} ELSE 'Sensitive Information' END AS information, pattern_id, count(*) AS n FROM f GROUP BY ALL")
def explain_findings(spark, sf_dir):
    found = _found(plans.findings(prompts(spark, sf_dir)), "findings", "doc_id")
    return found.groupBy(policy.explanation(F.col("pattern_id")).alias("information"), "pattern_id").agg(F.count(F.lit(1)).alias("n"))


_REASONS = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in policy.REASONS.items())


@register(f"{_PROMPT_ALL} SELECT doc_id, pattern_id, CASE pattern_id {_REASONS} ELSE {s(policy.OTHER_REASON)} END AS reason FROM f")
def explain_reasons(spark, sf_dir):
    found = _found(plans.findings(prompts(spark, sf_dir)), "findings", "doc_id")
    return found.select("doc_id", "pattern_id", policy.reason(F.col("pattern_id")).alias("reason"))


_STATE = "CASE event_id % 8 WHEN 0 THEN 'active' WHEN 1 THEN 'scanning' WHEN 2 THEN 'none' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' WHEN 5 THEN 'moderate' WHEN 6 THEN 'high' ELSE 'other' END"


@register(
    f"""SELECT state, status, CASE status WHEN 'scanning' THEN 'Scanning' WHEN 'high' THEN 'High risk detected' WHEN 'moderate' THEN 'Moderate risk detected' WHEN 'low' THEN 'Low risk detected' WHEN 'none' THEN 'No sensitive data detected' ELSE 'Waiting for activity…' END AS label,
 CASE status WHEN 'none' THEN 'Safe' ELSE upper(status[1:1]) || status[2:] END AS panel_badge, status = 'high' AS can_copy,
 CASE state WHEN 'active' THEN 'ON' WHEN 'scanning' THEN '…' WHEN 'low' THEN '!' WHEN 'medium' THEN '!' WHEN 'high' THEN '!' ELSE '' END AS badge,
 CASE state WHEN 'active' THEN '#9E9E9E' WHEN 'scanning' THEN '#9E9E9E' WHEN 'low' THEN '#F9A825' WHEN 'medium' THEN '#F57C00' WHEN 'high' THEN '#D32F2F' ELSE '#388E3C' END AS colour,
 CASE state WHEN 'scanning' THEN '#9ca3af' WHEN 'low' THEN '#eab308' WHEN 'moderate' THEN '#f97316' WHEN 'high' THEN '#ef4444' ELSE '#22c55e' END AS dot, count(*) AS n
FROM (SELECT {_STATE} AS state, CASE WHEN state IN ('scanning', 'high', 'moderate', 'low', 'none') THEN state ELSE 'idle' END AS status FROM events) GROUP BY ALL"""
)
def panel_status(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.expr(_STATE).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumns({"p": policy.panel(F.col("state")), "b": policy.badge(F.col("state")), "t": policy.theme(F.col("state"))})
    return d.select("state", "p.status", "p.label", F.col("p.badge").alias("panel_badge"), "p.can_copy", F.col("b.text").alias("badge"), "b.colour", "t.dot", "n")


_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@register(f"SELECT doc_id, CASE WHEN {_WORDS} <= 150 THEN 1500 ELSE 1500 + 200 * ceil(({_WORDS} - 150) / 100.0)::BIGINT END::BIGINT AS budget_ms FROM documents")
def timeout_budget(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", policy.time_budget_ms(F.col("text")).alias("budget_ms"))


# --- events: batch forms of the streams

_EVENTS = "SELECT event_id, ts, user_id AS tab_id, CASE WHEN event_id % 17 = 0 THEN 'navigate' ELSE event_type END AS type, event_type AS text, CASE WHEN value < 10 THEN 'none' WHEN value < 20 THEN 'low' WHEN value < 40 THEN 'moderate' ELSE 'high' END AS risk_level FROM {}"
_E = f"e AS ({_EVENTS.format('events')})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EVENTS.format("{t}"), t=table(spark, sf_dir, "events"))


@register(
    f"""WITH {_E}, b AS (SELECT *, sum(new_) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_ FROM e WINDOW w AS (PARTITION BY tab_id ORDER BY ts, event_id)))
SELECT tab_id, event_id, text, n_events, burst_start FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, burst ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY tab_id, burst) AS n_events, min(ts) OVER (PARTITION BY tab_id, burst) AS burst_start FROM b) WHERE rn = 1"""
)
def stream_debounce(spark, sf_dir):
    return ev.debounced(_events(spark, sf_dir), gap="2 hours").select("tab_id", "event_id", "text", "n_events", "burst_start")


@register(f"WITH {_E} SELECT tab_id, event_id, text FROM (SELECT *, lag(text) OVER w AS p, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY tab_id ORDER BY ts, event_id)) WHERE rn = 1 OR text IS DISTINCT FROM p")
def stream_skip_unchanged(spark, sf_dir):
    return ev.changed(_events(spark, sf_dir)).select("tab_id", "event_id", "text")


@register(
    f"""WITH {_E}, r AS (SELECT *, (risk_level = 'none' OR type = 'navigate') AS reset_ FROM e), p AS (SELECT *, sum(reset_::INT) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS epoch FROM r)
SELECT tab_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, epoch ORDER BY ts, event_id) AS rn FROM p WHERE risk_level = 'high' AND NOT reset_) WHERE rn = 1"""
)
def stream_auto_open(spark, sf_dir):
    return ev.auto_open(_events(spark, sf_dir)).select("tab_id", "event_id")


@register(f"WITH {_E} SELECT tab_id, arg_max(CASE WHEN type = 'navigate' THEN 'active' ELSE risk_level END, (ts, event_id)) AS badge, max(ts) AS ts, count(*) AS n_events FROM e GROUP BY tab_id")
def stream_badge(spark, sf_dir):
    return ev.badges(_events(spark, sf_dir))


_ACTS = "SELECT event_id, ts, user_id AS tab_id, CASE WHEN event_id % 23 = 0 THEN 'send_anyway' WHEN event_id % 4 = 3 THEN 'result' WHEN event_id % 4 = 2 THEN 'submit' ELSE 'input' END AS type, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type END AS text, CASE WHEN value < 30 THEN 'none' WHEN value < 60 THEN 'moderate' ELSE 'high' END AS risk_level FROM {}"
_A = f"a AS ({_ACTS.format('events')})"


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ACTS.format("{t}"), t=table(spark, sf_dir, "events"))


@register(
    f"""WITH {_A}, i AS (SELECT *, lead(CASE WHEN type = 'input' THEN ts END) OVER (PARTITION BY tab_id, type ORDER BY ts, event_id) AS nxt FROM a WHERE type IN ('input', 'send_anyway')),
f AS (SELECT *, CASE WHEN type = 'input' THEN ts + INTERVAL 2 HOUR ELSE ts END AS at_ FROM i WHERE type = 'send_anyway' OR nxt IS NULL OR nxt >= ts + INTERVAL 2 HOUR),
l AS (SELECT *, lag(CASE WHEN type = 'input' AND trim(text) <> '' THEN text ELSE '' END) OVER (PARTITION BY tab_id ORDER BY at_, event_id) AS last_ FROM f)
SELECT tab_id, ts, event_id, 'PENDING' AS state FROM a WHERE type = 'input' UNION ALL SELECT tab_id, ts, event_id, 'DONE' FROM a WHERE type = 'result'
UNION ALL SELECT tab_id, at_, event_id, CASE WHEN trim(text) = '' THEN 'IDLE' WHEN text = last_ THEN 'DONE' ELSE 'SCANNING' END FROM l WHERE type = 'input'"""
)
def stream_scan_states(spark, sf_dir):
    return ev.scan_states(_acts(spark, sf_dir), gap="2 hours")


@register(
    f"""WITH {_A}, e AS (SELECT *, count(*) FILTER (type = 'input') OVER (PARTITION BY tab_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM a),
r AS (SELECT tab_id, epoch, ts, event_id, risk_level FROM e WHERE type = 'result'),
s AS (SELECT s.tab_id, s.event_id, trim(s.text) = '' AS blank, (SELECT arg_max(r.risk_level, (r.ts, r.event_id)) FROM r WHERE r.tab_id = s.tab_id AND r.epoch = s.epoch AND (r.ts, r.event_id) < (s.ts, s.event_id)) AS b,
 (SELECT arg_min(r.risk_level, (r.ts, r.event_id)) FROM r WHERE r.tab_id = s.tab_id AND r.epoch = s.epoch AND (r.ts, r.event_id) > (s.ts, s.event_id)) AS f FROM e s WHERE s.type = 'submit')
SELECT tab_id, event_id, CASE WHEN blank THEN 'none' ELSE coalesce(b, f) END AS level, coalesce(CASE WHEN blank THEN 'none' ELSE coalesce(b, f) END, '') = 'none' AS allowed, NOT blank AND b IS NULL AS waited FROM s"""
)
def stream_submit_gate(spark, sf_dir):
    return ev.submit_gate(_acts(spark, sf_dir))


@register(
    f"""WITH {_A}, e AS (SELECT *, count(*) FILTER (type = 'input') OVER (PARTITION BY tab_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM a),
r AS (SELECT tab_id, epoch, ts, event_id, risk_level FROM e WHERE type = 'result'), i AS (SELECT tab_id, ts, event_id FROM e WHERE type = 'input'),
s AS (SELECT s.tab_id, s.event_id, s.text, trim(s.text) = '' AS blank, s.ts + INTERVAL 2 HOUR AS deadline,
 (SELECT arg_max(r.risk_level, (r.ts, r.event_id)) FROM r WHERE r.tab_id = s.tab_id AND r.epoch = s.epoch AND (r.ts, r.event_id) < (s.ts, s.event_id)) AS b,
 (SELECT arg_min(r.risk_level, (r.ts, r.event_id)) FROM r WHERE r.tab_id = s.tab_id AND r.epoch = s.epoch AND (r.ts, r.event_id) > (s.ts, s.event_id)) AS f,
 (SELECT min(r.ts) FROM r WHERE r.tab_id = s.tab_id AND r.epoch = s.epoch AND (r.ts, r.event_id) > (s.ts, s.event_id)) AS f_ts,
 (SELECT min(i.ts) FROM i WHERE i.tab_id = s.tab_id AND (i.ts, i.event_id) > (s.ts, s.event_id)) AS i_ts FROM e s WHERE s.type = 'submit'),
l AS (SELECT *, CASE WHEN blank THEN 'none' WHEN b IS NOT NULL THEN b WHEN f_ts <= deadline THEN f END AS level, NOT blank AND b IS NULL AS waited FROM s)
SELECT tab_id, event_id, level, coalesce(level, '') = 'none' AS allowed, waited, waited AND level IS NULL AND NOT coalesce(i_ts <= deadline, false) AS timed_out,
 CASE WHEN waited AND level IS NULL AND NOT coalesce(i_ts <= deadline, false) THEN text END AS text FROM l"""
)
def stream_timed_gate(spark, sf_dir):
    return timed.timed_gate(_acts(spark, sf_dir), budget=F.lit(7_200_000))


@register(f"WITH {_A} SELECT tab_id, event_id, text FROM (SELECT *, lag(text) OVER w AS p, lag(type) OVER w AS k, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY tab_id ORDER BY ts, event_id)) WHERE rn = 1 OR text IS DISTINCT FROM p OR k = 'send_anyway'")
def stream_send_anyway(spark, sf_dir):
    return ev.changed(_acts(spark, sf_dir), kind="type").select("tab_id", "event_id", "text")


@register(
    f"""WITH {_A}, q AS (SELECT event_id AS scan_id, ts, 3600000 AS budget_ms FROM a WHERE event_id % 2 = 0), r AS (SELECT event_id - event_id % 4 AS scan_id, ts, risk_level FROM a WHERE event_id % 2 = 1),
f AS (SELECT scan_id, min(ts) AS at_, arg_min(risk_level, (ts, risk_level)) AS level FROM r GROUP BY scan_id)
SELECT q.scan_id, CASE WHEN epoch_us(at_) - epoch_us(ts) <= 3600000000 THEN level ELSE 'none' END AS risk_level, NOT coalesce(epoch_us(at_) - epoch_us(ts) <= 3600000000, false) AS timed_out FROM q LEFT JOIN f USING (scan_id)"""
)
def stream_correlate(spark, sf_dir):
    a = _acts(spark, sf_dir)
    a = a.withColumn("ts", F.col("ts").cast("timestamp"))
    requests = a.where("event_id % 2 = 0").select(F.col("event_id").alias("scan_id"), "ts", F.lit(3_600_000).alias("budget_ms"))
    results = a.where("event_id % 2 = 1").select((F.col("event_id") - F.col("event_id") % 4).alias("scan_id"), "ts", "risk_level")
    return ev.correlated(requests, results).select("scan_id", "risk_level", "timed_out")


# --- corpus reports

_DOC_ALL = f"WITH {o.normalised('documents', 'doc_id')}, f AS ({o.merged(o.all_rows('n', 'doc_id'), 'doc_id')})"


@register(f"{_DOC_ALL} SELECT d.lang, f.pattern_id, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM f JOIN documents d USING (doc_id) GROUP BY ALL")
def corpus_by_rule(spark, sf_dir):
    d = plans.findings(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))
    return plans.explode_findings(d, "doc_id", "lang").groupBy("lang", "pattern_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))


@register(f"{_DOC_ALL}, {o.scored('f', 'n', 'doc_id')} SELECT l.toxic, z.risk_level, count(*) AS n_docs, round(avg(z.score), 6) AS mean_score FROM z JOIN labels l USING (doc_id) GROUP BY ALL")
def risk_vs_toxic(spark, sf_dir):
    # the labels join first, so only labelled texts are scanned; Spark broadcasts them while they are small
    labelled = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return plans.scan(labelled).groupBy("toxic", "risk_level").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"))


_CONV_ALL = f"WITH {o.normalised('conversations', 'conv_id, turn')}, f AS ({o.merged(o.all_rows('n', 'conv_id, turn'), 'conv_id, turn')}), {o.scored('f', 'n', 'conv_id, turn')}"


@register(f"{_CONV_ALL} SELECT c.role, z.risk_level, count(*) AS n_turns, sum(z.n_findings)::BIGINT AS n_findings FROM z JOIN conversations c USING (conv_id, turn) GROUP BY ALL")
def risk_by_role(spark, sf_dir):
    d = plans.scan(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return d.groupBy("role", "risk_level").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.size("findings")).alias("n_findings"))
