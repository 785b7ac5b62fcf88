"""Labelled evaluation: expected against actual labels, keep and drop checks, scorecards, legacy label conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.vocab import DEFAULT, RISKS, Vocabulary
from turnloom.operators.classify import classify, last_frames, plugin_list
from turnloom.operators.compress import compress
from turnloom.operators.route import route_policy

# --- fixed values: legacy labels -------------------------------------------------------------------

# expected type -> (intent, domain); a domain of None is inferred from the text, "?" intents are decided below
LEGACY_LABELS = {
    "debugging": ("debugging", "coding"),
    "code_generation": ("generation", "coding"),
    "problem_solving": ("task_execution", None),
    "commerce": ("?", "commerce"),
    "comparison": ("comparison", None),
    "medical_adjacent": ("?", "medical"),
    "legal_adjacent": ("?", "legal"),
    "decision_support": ("decision_support", None),
    "brainstorming": ("exploration", None),
    "research": ("exploration", None),
    "teaching": ("information_seeking", "education"),
    "explanation": ("information_seeking", None),
    "editing": ("correction", "general"),
    "casual_chat": ("information_seeking", "general"),
    "emotional_support": ("task_execution", "general"),
    "crisis": ("task_execution", "general"),
}
EVAL_INTENTS = {
    "commerce": ((r"(vs|compare|better|worth|alternatives)", "comparison"),),
    "medical_adjacent": ((r"(should i|safe|worried)", "decision_support"),),
    "legal_adjacent": ((r"(what can i do|options|should i)", "decision_support"),),
}
CONVERT_INTENTS = {
    "commerce": (
        (r"(vs|versus|compare|better|worth it|alternatives)", "comparison"),
        (r"(should i|which plan|16gb or 32gb)", "decision_support"),
    ),
    "medical_adjacent": ((r"(should i|is it safe)", "decision_support"),),
    "legal_adjacent": ((r"(what can i do|should i|options)", "decision_support"),),
}
OTHER_INTENT = {"commerce": "task_execution", "medical_adjacent": "information_seeking", "legal_adjacent": "information_seeking"}
EVAL_DOMAINS = (
    (r"(code|api|database|deploy|lambda|auth|bug|webhook|typescript|javascript|python|rust|react|sql|docker"
     r"|github actions|terraform|supabase|prisma)", "coding"),
    (r"(order|refund|support|ticket|delivery)", "customer_support"),
    (r"(sales|pricing|crm|competitor|lead)", "sales"),
    (r"(doctor|symptom|medication|headache|fever|blood pressure|pain|diabetes|rash|sleep|ibuprofen|paracetamol)",
     "medical"),
    (r"(contract|landlord|employer|legal|gdpr|trademark|copyright|equity|patent|privacy policy|cease and desist"
     r"|non-compete)", "legal"),
    (r"(buy|laptop|monitor|keyboard|hosting|chair|vpn|domain|registrar|gateway|iphone|samsung|aws|gcp|figma|postman"
     r"|notion|confluence)", "commerce"),
    (r"(teach|learn|interview|study|explain|example|cap theorem|binary search|event loop)", "education"),
)
PROBLEM_DOMAINS = (
    (r"(api|code|database|microservice|deployment|lambda|android|bug|prompt injection|auth|search feature"
     r"|test coverage|merge conflict)", "coding"),
    (r"(support tickets|order|refund|customer)", "customer_support"),
    (r"(sales|pricing|crm|lead)", "sales"),
    (r"(doctor|symptom|medication|blood pressure|headache|fever|pain|sleep)", "medical"),
    (r"(contract|landlord|employer|legal|gdpr|trademark|copyright|equity|patent)", "legal"),
    (r"(laptop|buy|monitor|keyboard|hosting|chair|vpn|domain|registrar|gateway)", "commerce"),
    (r"(learn|teach|interview|study|explain)", "education"),
)
COMPARISON_DOMAINS = (
    (r"(iphone|samsung|laptop|monitor|keyboard|vercel|netlify|aws|gcp|supabase|firebase|figma|postman)", "commerce"),
    *PROBLEM_DOMAINS,
)
DECISION_DOMAINS = (
    (r"(typescript|javascript|monorepo|repos|mobile app|web version|no-code|sdk|open source)", "coding"),
    (r"(seed round|bootstrap|pricing|revenue)", "commerce"),
    (r"(patent|legal|non-compete|contract)", "legal"),
    (r"(mba|learn|education)", "education"),
)


def first_pattern(low: Column, rules, default: str) -> Column:
    out = None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), F.lit(label)) if out is None else out.when(low.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def legacy_label(kind: Column, low: Column, variant: str = "eval") -> Column:
    """(intent, domain) of a legacy label; two published variants differ in their word lists."""
    convert = variant == "convert"
    intents = CONVERT_INTENTS if convert else EVAL_INTENTS
    labels = dict(LEGACY_LABELS)
    if convert:
        labels["information_seeking"] = ("information_seeking", None)

    def domain_for(name: str) -> Column:
        rules = PROBLEM_DOMAINS if convert else EVAL_DOMAINS
        if convert and name == "comparison":
            rules = COMPARISON_DOMAINS
        if convert and name == "decision_support":
            rules = DECISION_DOMAINS
        return first_pattern(low, rules, "general")

    intent = domain = None
    for name, (label, known) in labels.items():
        i = F.lit(label) if label != "?" else first_pattern(low, intents[name], OTHER_INTENT[name])
        d = F.lit(known) if known else domain_for(name)
        intent = F.when(kind == name, i) if intent is None else intent.when(kind == name, i)
        domain = F.when(kind == name, d) if domain is None else domain.when(kind == name, d)
    return F.struct(
        intent.otherwise(F.lit("task_execution")).alias("intent"), domain.otherwise(domain_for("")).alias("domain")
    )


def normalize_risk(risk: Column, kind: Column) -> Column:
    """Known risks in the given order, plus the protected marker for crisis cases."""
    known = F.array(*[F.lit(r) for r in RISKS])
    kept = F.array_distinct(F.filter(F.coalesce(risk, F.array().cast("array<string>")), lambda r: F.array_contains(known, r)))
    return F.when(kind == "crisis", F.array_union(kept, F.array(F.lit("protected_context")))).otherwise(kept)


def case_text(message: Column, history: Column) -> Column:
    """Message and history contents, lower-cased, one per line."""
    past = F.coalesce(F.array_join(F.transform(history, lambda h: h["content"]), "\n"), F.lit(""))
    return F.lower(F.concat(message, F.lit("\n"), past))


def convert_legacy(rows: DataFrame) -> DataFrame:
    """Legacy cases to labelled cases."""
    low = case_text(F.col("message"), F.col("history"))
    mapped = rows.withColumn("m", legacy_label(F.col("expectedType"), low, "convert"))
    return mapped.select(
        "id",
        "message",
        "history",
        F.col("m.intent").alias("expectedIntent"),
        "expectedState",
        F.col("m.domain").alias("expectedDomain"),
        normalize_risk(F.col("expectedRisk"), F.col("expectedType")).alias("expectedRisk"),
        F.col("expectedType").alias("legacyType"),
        "notes",
    )


def label_distribution(rows: DataFrame, intent: str = "expectedIntent", domain: str = "expectedDomain") -> DataFrame:
    """Counts per intent and per domain: one pass, two grouping sets."""
    dims = F.array(
        F.struct(F.lit("intent").alias("dimension"), F.col(intent).alias("label")),
        F.struct(F.lit("domain").alias("dimension"), F.col(domain).alias("label")),
    )
    pairs = rows.select(F.explode(dims).alias("d")).select("d.dimension", "d.label")
    return pairs.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))


def expected_labels(cases: DataFrame) -> DataFrame:
    """Explicit labels, else the mapped legacy label; state defaults to opening."""
    low = case_text(F.col("message"), F.col("history"))
    kind = F.coalesce("expectedType", F.lit("task_execution"))
    mapped = legacy_label(kind, low, "eval")
    none = F.array().cast("array<string>")
    explicit = (F.coalesce("expectedIntent", F.lit("")) != "") & (F.coalesce("expectedDomain", F.lit("")) != "")
    rows = cases.withColumn("_m", mapped)
    return rows.select(
        "id",
        F.when(explicit, F.col("expectedIntent")).otherwise(F.col("_m.intent")).alias("x_intent"),
        F.when(explicit, F.col("expectedDomain")).otherwise(F.col("_m.domain")).alias("x_domain"),
        F.coalesce("expectedState", F.lit("opening")).alias("x_state"),
        F.when(explicit, F.coalesce("expectedRisk", none))
        .otherwise(normalize_risk(F.col("expectedRisk"), F.coalesce("expectedType", F.lit(""))))
        .alias("x_risk"),
        F.coalesce("mustKeep", none).alias("must_keep"),
        F.coalesce("shouldDrop", none).alias("should_drop"),
        F.col("expectedMinSavingsPct").alias("min_savings_pct"),
        "message",
        "notes",
    )


def case_turns(cases: DataFrame) -> DataFrame:
    """Cases as a turn table: the history, then the message as the last user turn."""
    message = "array<struct<role:string,content:string>>"
    past = F.transform("history", lambda h: F.struct(h["role"].alias("role"), h["content"].alias("content")))
    past = F.coalesce(past, F.array().cast(message))
    last = F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")))
    return cases.select(F.col("id").alias("conv_id"), F.posexplode(F.concat(past, last)).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text")
    )


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def keep_checks(values: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.transform(values, lambda v: F.struct(v.alias("value"), low.contains(F.lower(v)).alias("kept")))


def drop_checks(values: Column, text: Column) -> Column:
    """A value is dropped when it does not occur as a whole word."""

    def dropped(v: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(v, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))
        edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        return ~F.call_function("rlike", text, F.concat(F.lit("(?i)" + edge), quoted, F.lit(edge)))

    return F.transform(values, lambda v: F.struct(v.alias("value"), dropped(v).alias("dropped")))


def evaluate(cases: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per case with expected and actual labels, checks and pass flags."""
    turns = case_turns(cases)
    result = compress(turns, protect=False, vocab=vocab)
    text = result.turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("out_pos", "text"))).alias("l")
    ).select("conv_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("compressed_text"))
    actual = result.summary.select(
        F.col("conv_id").alias("id"), "intent", "domain", "state", "risk", "original_tokens", "compressed_tokens", "tokens_saved"
    ).join(text.withColumnRenamed("conv_id", "id"), "id")
    rows = expected_labels(cases).join(actual, "id")
    return score_cases(rows)


def score_cases(rows: DataFrame) -> DataFrame:
    """Pass flags for rows that hold expected (x_*) and actual labels, token counts and the compressed text."""
    ratio = F.when(F.col("original_tokens") == 0, F.lit(0.0)).otherwise(F.col("tokens_saved") / F.col("original_tokens"))
    rows = rows.withColumns(
        {
            "ratio": ratio,
            "must_keep_checks": keep_checks(F.col("must_keep"), F.col("compressed_text")),
            "should_drop_checks": drop_checks(F.col("should_drop"), F.col("compressed_text")),
        }
    )
    rows = rows.withColumns(
        {
            "pass_intent": F.col("intent") == F.col("x_intent"),
            "pass_domain": F.col("domain") == F.col("x_domain"),
            "pass_state": F.col("state") == F.col("x_state"),
            "pass_risk": same_set(F.col("x_risk"), F.col("risk")),
            "pass_must_keep": F.forall("must_keep_checks", lambda c: c["kept"]),
            "pass_should_drop": F.forall("should_drop_checks", lambda c: c["dropped"]),
            "pass_savings": F.col("min_savings_pct").isNull() | (F.col("ratio") * 100 >= F.col("min_savings_pct")),
        }
    )
    quality = F.col("pass_must_keep") & F.col("pass_should_drop") & F.col("pass_savings")
    value = F.col("pass_intent") & F.col("pass_domain") & quality
    return rows.withColumns(
        {
            "pass_quality": quality,
            "pass_value": value,
            "pass_all": value & F.col("pass_state") & F.col("pass_risk"),
        }
    )


PASS_FLAGS = (
    "all", "intent", "domain", "state", "risk", "must_keep", "should_drop", "savings", "quality", "value",
)


def scorecard(results: DataFrame, flags=PASS_FLAGS) -> DataFrame:
    """Pass rates per dimension, token totals, savings ratio and failure counts."""

    def rate(flag: str) -> Column:
        return F.coalesce(F.avg(F.col(f"pass_{flag}").cast("double")), F.lit(0.0)).alias(f"{flag}_rate")

    original, saved = F.coalesce(F.sum("original_tokens"), F.lit(0)), F.coalesce(F.sum("tokens_saved"), F.lit(0))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *[rate(f) for f in flags],
        original.alias("total_original_tokens"),
        F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("total_compressed_tokens"),
        saved.alias("total_tokens_saved"),
        F.when(original == 0, F.lit(0.0)).otherwise(saved / original).alias("token_savings_ratio"),
        F.count_if(~F.col("pass_value")).alias("value_failures"),
        F.count_if(~F.col("pass_all")).alias("strict_failures"),
    )


def route_savings(cases: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Route passes, original and saved tokens and their ratio over cases(id, message, history, expected labels)."""
    summary = compress(case_turns(cases), protect=False, vocab=vocab).summary
    rows = summary.join(cases.select(F.col("id").alias("conv_id"), "expectedDomain", "expectedIntent"), "conv_id")
    passed = (F.col("domain") == F.col("expectedDomain")) & (F.col("intent") == F.col("expectedIntent"))
    original, saved = F.sum("original_tokens"), F.sum("tokens_saved")
    return rows.agg(
        F.count_if(passed).alias("route_passes"),
        F.count(F.lit(1)).alias("cases"),
        original.alias("original_tokens"),
        saved.alias("tokens_saved"),
        F.when(original == 0, F.lit(0.0)).otherwise(saved / original).alias("savings_ratio"),
    )


def plugin_eval(cases: DataFrame, plugins, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Per case: domain and prompt checks, for cases(id, message, history, plugin_ids, expectedDomain, contains, excludes).

    Every case uses its own subset of the plugin list, in the order of ``plugin_ids``.
    """
    known = plugin_list(plugins)
    turns = case_turns(cases)
    table = F.array(
        *[
            F.struct(F.lit(p["id"]).alias("id"), F.array(*[F.lit(k.lower()) for k in p["keywords"]]).alias("keywords"))
            for p in known
        ]
    )
    low = F.lower("text")
    hit = F.transform(F.filter(table, lambda p: F.exists(p["keywords"], lambda k: low.contains(k))), lambda p: p["id"])
    seen = turns.select("conv_id", F.explode(hit).alias("plugin")).distinct()
    wanted = cases.select(F.col("id").alias("conv_id"), F.posexplode("plugin_ids").alias("ord", "plugin"))
    first = wanted.join(seen, ["conv_id", "plugin"]).groupBy("conv_id").agg(F.min_by("plugin", "ord").alias("label"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    labels = first.join(last, "conv_id").withColumn("score", F.lit(0.95))
    frames = last_frames(classify(turns, vocab=vocab, domain_labels=labels))
    routed = route_policy(frames, known).select(F.col("conv_id").alias("id"), "domain", "system_prompt")
    prompt = F.lower("system_prompt")
    none = F.array().cast("array<string>")
    return cases.join(routed, "id").select(
        "id",
        "domain",
        (F.col("domain") == F.col("expectedDomain")).alias("pass_domain"),
        F.forall(F.coalesce("contains", none), lambda t: prompt.contains(F.lower(t))).alias("pass_contains"),
        F.forall(F.coalesce("excludes", none), lambda t: ~prompt.contains(F.lower(t))).alias("pass_excludes"),
    ).withColumn("pass", F.col("pass_domain") & F.col("pass_contains") & F.col("pass_excludes"))


def memory_eval(cases: DataFrame, page_text: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per case: all expected terms in the pages and in the recalled context.

    cases(id, expected_pages, expected_context), page_text(id, page_text), contexts(id, context).
    """
    rows = cases.join(page_text, "id", "left").join(contexts, "id", "left")
    pages, context = F.lower(F.coalesce("page_text", F.lit(""))), F.lower(F.coalesce("context", F.lit("")))
    return rows.select(
        "id",
        F.forall("expected_pages", lambda t: pages.contains(F.lower(t))).alias("pages_ok"),
        F.forall("expected_context", lambda t: context.contains(F.lower(t))).alias("context_ok"),
        (pages != "").alias("has_pages"),
    ).withColumn("pass", F.col("pages_ok") & F.col("context_ok") & F.col("has_pages"))


def pass_rate(results: DataFrame, flag: str = "pass") -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(flag).alias("passed"),
        F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


