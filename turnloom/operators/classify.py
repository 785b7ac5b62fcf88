"""Turn classification: lifted features, then the ordered rule cascades for domain, intent, state and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.vocab import DEFAULT, HIGH_REUSE_DOMAINS, NO_REUSE_DOMAINS, PROTECTED_DOMAINS, SCORED_DOMAINS, Vocabulary
from turnloom.operators.plugins import first_plugins
from turnloom.operators.signals import (
    LOOKBACK_RISK,
    LOOKBACK_TOPIC,
    LOOKBACK_URGENCY,
    Layout,
    Lifted,
)
from turnloom.operators.turns import valid_turns
from turnloom.plans.segments import SEGMENT, segment_of

LOOKBACKS = (LOOKBACK_RISK, LOOKBACK_URGENCY, LOOKBACK_TOPIC)


MAX_LISTED = 1_000  # plugins of a table that may become rules of a plan


def plugin_list(plugins) -> tuple:
    """Plugins as a tuple of dicts in order, for uses that make them rules of the plan; a longer table is an error."""
    if plugins is None:
        return ()
    if isinstance(plugins, DataFrame):
        rows = plugins.orderBy("ord").limit(MAX_LISTED + 1).collect()
        if len(rows) > MAX_LISTED:
            raise ValueError(f"more than {MAX_LISTED} plugins: classify takes a table of any length")
        return tuple(r.asDict() for r in rows)
    return tuple(plugins)


def features(turns: DataFrame, layout: Layout, size: int = SEGMENT) -> DataFrame:
    """One narrow row per valid turn: (conv_id, seg, turn, feat)."""
    rows = valid_turns(turns).withColumn("seg", segment_of(F.col("turn"), size))
    return layout.features(rows, keep=("conv_id", "seg", "turn"))


def _carry(rows: DataFrame, layout: Layout) -> DataFrame:
    """What each segment inherits from the earlier segments of its conversation; none for the first one."""
    summed = range(layout.score_slot, layout.size)
    ored = [layout.CONTEXT, *range(layout.plugin_slot, layout.score_slot)]
    newest = F.sort_array(F.collect_list(F.struct("turn", F.col("feat")[layout.NEAR].alias("near"))), asc=False)
    per_segment = rows.groupBy("conv_id", "seg").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bit_or(F.col("feat")[i]).alias(f"s{i}") for i in ored],
        *[F.sum(F.col("feat")[i]).alias(f"s{i}") for i in summed],
        F.transform(F.slice(newest, 1, LOOKBACK_RISK), lambda x: x["near"]).alias("tail"),
    )
    w = Window.partitionBy("conv_id").orderBy("seg")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tails = F.collect_list("tail").over(w.rowsBetween(-LOOKBACK_RISK, -1))
    return per_segment.select(
        "conv_id",
        "seg",
        F.sum("n").over(before).alias("carry_n"),
        *[F.bit_or(f"s{i}").over(before).alias(f"carry_{i}") for i in ored],
        *[F.sum(f"s{i}").over(before).alias(f"carry_{i}") for i in summed],
        F.slice(F.flatten(F.reverse(tails)), 1, LOOKBACK_RISK).alias("carry_tail"),
    ).filter(F.col("carry_n").isNotNull())


def lift(rows: DataFrame, layout: Layout) -> DataFrame:
    """Windows per (conversation, segment) plus the carry of earlier segments.

    ``feat`` is opaque to column pruning, so the window branch and the carry branch read the
    same shuffle and the text is scanned once.
    """
    rows = rows.repartition("conv_id", "seg")
    carry = _carry(rows, layout)
    w = Window.partitionBy("conv_id", "seg").orderBy("turn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    previous = w.rowsBetween(Window.unboundedPreceding, -1)
    feat = F.col("feat")
    zero = F.lit(0).cast("long")
    local = rows.select(
        "conv_id",
        "seg",
        "turn",
        "feat",
        (F.row_number().over(w) - 1).alias("n_in"),
        F.bit_or(feat[layout.CONTEXT]).over(previous).alias("h"),
        *[
            F.bit_or(feat[i]).over(upto).alias(f"w{i}")
            for i in [layout.CONTEXT, *range(layout.plugin_slot, layout.score_slot)]
        ],
        *[F.sum(feat[i]).over(upto).alias(f"w{i}") for i in range(layout.score_slot, layout.size)],
        *[F.bit_or(feat[layout.NEAR]).over(w.rowsBetween(-n, -1)).alias(f"near{n}") for n in LOOKBACKS],
    )
    joined = local.join(carry, ["conv_id", "seg"], "left")

    def either(a: Column, b: Column) -> Column:
        return F.coalesce(a, zero).bitwiseOR(F.coalesce(b, zero))

    def tail_or(n: int) -> Column:
        missing = F.lit(n) - F.col("n_in")
        ored = F.aggregate(F.slice("carry_tail", F.lit(1), F.greatest(missing, F.lit(0))), zero, lambda a, x: a.bitwiseOR(x))
        return F.when(F.col("carry_tail").isNotNull() & (missing > 0), ored).otherwise(zero)

    lifted = joined.select(
        "conv_id",
        "turn",
        "feat",
        (F.col("n_in") + F.coalesce("carry_n", zero)).cast("long").alias("pos"),
        either(F.col("h"), F.col(f"carry_{layout.CONTEXT}")).alias("hist_bits"),
        *[
            either(F.col(f"w{i}"), F.col(f"carry_{i}")).alias(f"slot{i}")
            for i in [layout.CONTEXT, *range(layout.plugin_slot, layout.score_slot)]
        ],
        *[
            (F.col(f"w{i}") + F.coalesce(f"carry_{i}", zero)).alias(f"slot{i}")
            for i in range(layout.score_slot, layout.size)
        ],
        *[either(F.col(f"near{n}"), tail_or(n)).alias(f"before{n}") for n in LOOKBACKS],
    )
    return lifted


def lift_arrays(rows: DataFrame, layout: Layout, feats: str = "feats") -> DataFrame:
    """The same columns for the last turn of a bounded, ordered array of packed features."""
    size = f"size({feats})"

    def ored(items: str, slot: int) -> Column:
        return F.expr(f"aggregate({items}, 0L, (a, x) -> a | x[{slot}])")

    def summed(slot: int) -> Column:
        return F.expr(f"aggregate({feats}, 0L, (a, x) -> a + x[{slot}])")

    def previous(n: int | None) -> str:
        start = "1" if n is None else f"greatest(1, {size} - {n})"
        return f"slice({feats}, {start}, {size} - {start})"

    return rows.withColumns(
        {
            "feat": F.element_at(feats, -1),
            "pos": F.expr(f"CAST({size} - 1 AS BIGINT)"),
            "hist_bits": ored(previous(None), layout.CONTEXT),
            **{f"slot{i}": ored(feats, i) for i in [layout.CONTEXT, *range(layout.plugin_slot, layout.score_slot)]},
            **{f"slot{i}": summed(i) for i in range(layout.score_slot, layout.size)},
            **{f"before{n}": ored(previous(n), layout.NEAR) for n in LOOKBACKS},
        }
    )


def lifted_view(layout: Layout) -> Lifted:
    """Named access to the columns that lift and lift_arrays produce."""
    return Lifted(layout)


def first_case(rules: list[tuple[Column, Column | str]], default) -> Column:
    """CASE WHEN over ordered rules: the first condition that holds wins."""

    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    out = None
    for cond, result in rules:
        out = F.when(cond, value(result)) if out is None else out.when(cond, value(result))
    return out.otherwise(value(default))


def plugin_domain(f: Lifted) -> Column:
    """Id of the first plugin (list order) with a keyword in the context, else null."""
    plugins = f.layout.plugins
    if not plugins:
        return F.lit(None).cast("string")
    cases = [(f.plugin(i), p["id"]) for i, p in enumerate(plugins)]
    return first_case(cases, F.lit(None).cast("string"))


def domain_scores(f: Lifted) -> dict[str, Column]:
    """Match counts per domain on the context, with the structure bonuses of the current turn."""
    scores = {d: f.score(i) for i, d in enumerate(SCORED_DOMAINS)}
    zero, three, two = (F.lit(n).cast("long") for n in (0, 3, 2))
    scores["coding"] = scores["coding"] + F.when(f.cur("code_block") | f.cur("error_signal"), three).otherwise(zero)
    scores["commerce"] = scores["commerce"] + F.when(f.cur("price_constraint"), two).otherwise(zero)
    return scores


def domain_by_score(f: Lifted) -> Column:
    """Highest score wins, ties by list order; medical wins when at most one point behind; none is general."""
    scores = domain_scores(f)
    best = F.greatest(*scores.values())
    medical = scores["medical"]
    near_medical = (medical > 0) & (best - medical <= 1)
    ranked = [(scores[d] == best, d) for d in SCORED_DOMAINS]
    return first_case([(best == 0, "general"), (near_medical, "medical"), *ranked], "general")


def domain_rules(f: Lifted) -> Column:
    """Ordered rules on the current turn and the context; scores decide when none applies."""
    return first_case(
        [
            (f.ctx("self_harm"), "general"),
            (f.cur("teaching"), "education"),
            (f.cur("scheduling"), "general"),
            (f.ctx("tone_edit"), "general"),
            (f.ctx("hosting"), "commerce"),
            (f.ctx("support_verb") & f.ctx("order_reference"), "customer_support"),
            (f.ctx("device"), "commerce"),
            (f.ctx("stack"), "coding"),
            (f.cur("clinical"), "medical"),
            (f.ctx("deal"), "sales"),
            (f.ctx("budget") & ~f.ctx("technical"), "sales"),
            (f.cur("contract"), "legal"),
            (f.cur("legal_word") & f.ctx("legal_advice"), "legal"),
            (f.cur("support_word"), "customer_support"),
        ],
        domain_by_score(f),
    )


def intent_rules(f: Lifted, domain: Column, urgency: Column) -> Column:
    def is_(name: str) -> Column:
        return domain == name

    sales_intent = first_case(
        [(f.cur("deal_forward"), "decision_support"), (f.cur("deal_doubt"), "objection_handling")], "decision_support"
    )
    support_intent = first_case(
        [(f.ctx("support_escalation"), "escalation"), (f.cur("when_status"), "information_seeking")], "task_execution"
    )
    return first_case(
        [
            (f.cur("cover_up"), "task_execution"),
            (f.cur("confirm"), "confirmation_seeking"),
            (f.cur("error_signal") | f.cur("failure"), "debugging"),
            (is_("coding") & f.ctx("build_work"), "generation"),
            (is_("coding") & f.ctx("fault_work"), "debugging"),
            (f.cur("compare"), "comparison"),
            (is_("commerce") & f.ctx("product_choice"), "comparison"),
            (f.cur("summarize"), "summarization"),
            (is_("education") & f.cur("review") & f.ctx("summary_topic"), "summarization"),
            (f.cur("correct_text"), "correction"),
            (f.cur("produce"), "generation"),
            (is_("medical") & f.ctx("care_question"), "information_seeking"),
            (is_("medical") & f.cur("safety_question"), "decision_support"),
            (is_("legal") & f.cur("legal_choice"), "decision_support"),
            (f.cur("decide"), "decision_support"),
            (is_("sales") & f.ctx("deal_topic"), sales_intent),
            (f.cur("disagree"), "correction"),
            (is_("customer_support") & f.ctx("support_topic"), support_intent),
            (is_("education") & f.cur("next_lesson"), "information_seeking"),
            (f.cur("schedule_task"), "task_execution"),
            (f.cur("question"), "information_seeking"),
            (f.cur("ideas"), "exploration"),
            (f.cur("hesitation"), "objection_handling"),
            (
                (urgency == "high") | f.cur("resolve_now"),
                first_case([(is_("customer_support"), "escalation")], "task_execution"),
            ),
            (f.cur("generic_reference") & is_("coding"), "debugging"),
        ],
        "task_execution",
    )


def state_rules(f: Lifted, domain: Column, urgency: Column) -> Column:
    return first_case(
        [
            (f.n_before == 0, "opening"),
            (f.cur("alarm"), "escalating"),
            (f.cur("thanks"), "closing"),
            ((urgency == "high") | f.cur("persistence"), "escalating"),
            (f.hist("unresolved_call"), "escalating"),
            (f.cur("conclude") | f.cur("act"), "resolving"),
            (f.cur("new_topic"), "pivoting"),
            (f.cur("back_reference"), "returning"),
            (f.small_talk_before() & (domain != "general"), "returning"),
        ],
        "deepening",
    )


def risk_rules(f: Lifted, domain: Column, keywords: Column) -> Column:
    crisis = f.near_group("crisis", LOOKBACK_RISK) | f.ctx("crisis_phrase")
    unsafe = f.near_group("unsafe", LOOKBACK_RISK) | f.ctx("unsafe_phrase")
    money = F.exists(keywords, lambda k: k.contains("invest") | k.contains("price"))
    return F.array_compact(
        F.array(
            F.when(crisis, F.lit("crisis")),
            F.when(crisis, F.lit("protected_context")),
            F.when(unsafe, F.lit("unsafe_request")),
            F.when(domain == "medical", F.lit("medical_caution")),
            F.when(domain == "legal", F.lit("legal_caution")),
            F.when((domain == "commerce") & money, F.lit("financial_caution")),
        )
    )


def confidence(intent: Column, state: Column, domain_conf: Column, risk: Column, n_signals: Column) -> Column:
    base = F.when(intent == "task_execution", F.lit(0.68)).otherwise(F.lit(0.78))
    boost = F.least(F.lit(0.16), n_signals * F.lit(0.025))
    return F.struct(
        F.round(F.least(F.lit(0.96), base + boost), 2).alias("intent"),
        F.when(state == "opening", F.lit(0.9)).otherwise(F.lit(0.74)).alias("state"),
        domain_conf.alias("domain"),
        F.when(F.size(risk) == 0, F.lit(1.0)).otherwise(F.lit(0.88)).alias("risk"),
    )


def classify(
    turns: DataFrame,
    plugins=None,
    vocab: Vocabulary = DEFAULT,
    domain_labels: DataFrame | None = None,
    size: int = SEGMENT,
    user_turns_only: bool = True,
) -> DataFrame:
    """One frame per user turn: the turn as the current message, everything before it as history.

    ``domain_labels(conv_id, turn, label, score)`` carries the output of a domain model. A plugin
    wins over the label, and a turn without a label falls back to the rules. ``plugins`` is a short list, which becomes
    rules of the plan, or a table (ord, id, keywords) of any length, which is joined.
    """
    joined = isinstance(plugins, DataFrame)
    layout = Layout(vocab, () if joined else plugin_list(plugins))
    lifted = lift(features(turns, layout, size), layout)
    if user_turns_only:
        lifted = lifted.filter(lifted_view(layout).cur("is_user"))
    found = first_plugins(turns, plugins, size) if joined else None
    return label_frames(lifted, layout, ("conv_id", "turn", "pos"), domain_labels, found)


def label_frames(
    lifted: DataFrame, layout: Layout, keep: tuple, domain_labels: DataFrame | None = None, plugins: DataFrame | None = None
) -> DataFrame:
    """Run the rule cascades over lifted columns; ``keep`` names the columns to carry along.

    ``plugins(conv_id, turn, plugin)`` are found plugins, for a layout without a list of them.
    """
    f = lifted_view(layout)
    staged = lifted.select(
        "*",
        f.keywords().alias("keywords"),
        f.structures().alias("structures"),
        f.urgency().alias("urgency"),
        f.affect().alias("affect"),
        *([] if plugins is not None else [plugin_domain(f).alias("plugin")]),
    )
    if plugins is not None:
        staged = staged.join(plugins, ["conv_id", "turn"], "left")
    by_rule = domain_rules(f)
    if domain_labels is not None:
        labels = domain_labels.select("conv_id", "turn", "label", F.col("score").cast("double").alias("label_score"))
        staged = staged.join(labels, ["conv_id", "turn"], "left")
        staged = staged.withColumn("domain", F.coalesce("plugin", "label", by_rule))
        rule_conf = F.when(F.col("domain") == "general", F.lit(0.62)).otherwise(F.lit(0.88))
        conf = F.when(F.col("plugin").isNotNull(), F.lit(0.95)).otherwise(
            F.when(F.col("label").isNotNull(), F.col("label_score")).otherwise(rule_conf)
        )
    else:
        staged = staged.withColumn("domain", F.coalesce("plugin", by_rule))
        conf = F.when(F.col("domain") == "general", F.lit(0.62)).otherwise(F.lit(0.88))

    domain, urgency = F.col("domain"), F.col("urgency")
    staged = staged.withColumns(
        {
            "intent": intent_rules(f, domain, urgency),
            "state": state_rules(f, domain, urgency),
            "risk": risk_rules(f, domain, F.col("keywords")),
        }
    )
    n_signals = F.size("keywords") + F.size("structures")
    return staged.select(
        *keep,
        "intent",
        "state",
        "domain",
        "risk",
        F.struct("keywords", "structures", "urgency", "affect").alias("signals"),
        confidence(F.col("intent"), F.col("state"), conf, F.col("risk"), n_signals).alias("confidence"),
        f.context_chars().alias("context_chars"),
    )


def last_frames(frames: DataFrame) -> DataFrame:
    """The frame of the last user turn of each conversation; combined before the shuffle."""
    columns = [c for c in frames.columns if c not in ("conv_id", "turn")]
    packed = frames.groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by(F.struct(*columns), F.col("turn")).alias("frame")
    )
    return packed.select("conv_id", "turn", *[F.col(f"frame.{c}").alias(c) for c in columns])


def lifted_columns(turns: DataFrame, vocab: Vocabulary = DEFAULT, size: int = SEGMENT, plugins=None) -> tuple[DataFrame, Lifted]:
    """The lifted feature table for callers that want single signals instead of whole frames."""
    layout = Layout(vocab, plugin_list(plugins))
    return lift(features(turns, layout, size), layout), lifted_view(layout)


def protected_gate(frames: DataFrame) -> DataFrame:
    """Mark protected conversations: medical, legal or crisis turns are neither compressed nor monetised."""
    protected = F.col("domain").isin(*PROTECTED_DOMAINS) | F.array_contains("risk", "crisis")
    return frames.withColumns(
        {
            "protected": protected,
            "compress_allowed": ~protected,
            "monetise_allowed": ~protected,
            "retention": F.when(protected, F.lit("elevated")).otherwise(F.lit("standard")),
        }
    )


def cacheable(domain: Column) -> Column:
    return ~domain.isin(*NO_REUSE_DOMAINS)


def high_reuse(domain: Column) -> Column:
    return domain.isin(*HIGH_REUSE_DOMAINS)


def model_context(turns: DataFrame, limit: int = 512, size: int = SEGMENT) -> DataFrame:
    """The text a domain model sees per user turn: the turn, then its history from the start, first ``limit`` chars.

    Every history turn adds at least its line break, so at most ``limit`` early turns matter; they
    are cut to ``limit`` characters and found with a bounded top-k per conversation.
    """
    valid = valid_turns(turns)
    w = Window.partitionBy("conv_id").orderBy("turn")
    early = valid.select("conv_id", "turn", F.substring(F.lower("text"), 1, limit).alias("t"))
    early = early.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    before = F.sum(F.length("t") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    early = early.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit)
    heads = early.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("head"))
    users = valid.filter(F.col("role") == "user").select("conv_id", "turn", F.substring(F.lower("text"), 1, limit).alias("cur"))
    history = F.array_join(
        F.transform(F.filter("head", lambda h: h["turn"] < F.col("turn")), lambda h: h["t"]), "\n"
    )
    return users.join(heads, "conv_id").select(
        "conv_id", "turn", F.substring(F.concat("cur", F.lit("\n"), history), 1, limit).alias("context")
    )


def predict_labels(contexts: DataFrame, make_predict, batch_size: int = 64) -> DataFrame:
    """Run a batch model over contexts; ``make_predict`` loads it once per worker and returns labels and scores."""
    from pyspark.ml.functions import predict_batch_udf

    result = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    predict = predict_batch_udf(make_predict, return_type=result, batch_size=batch_size)
    scored = contexts.withColumn("p", predict("context"))
    return scored.select("conv_id", "turn", F.col("p.label").alias("label"), F.col("p.score").alias("score"))


