"""Vocabulary: word groups, rules and policy texts, all plain data and all replaceable.

Everything under "fixed values" has to equal the published behaviour word for word,
otherwise labels, facts and token counts would differ.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from turnloom.functions.regex import Rule, raw, terms

# --- fixed values: closed label sets -------------------------------------------------------

INTENTS = (
    "information_seeking", "task_execution", "decision_support", "comparison", "summarization", "generation",
    "debugging", "escalation", "objection_handling", "confirmation_seeking", "exploration", "correction",
)
STATES = ("opening", "deepening", "pivoting", "returning", "escalating", "resolving", "closing")
DOMAINS = ("general", "coding", "customer_support", "sales", "legal", "medical", "education", "commerce")
RISKS = (
    "medical_caution", "legal_caution", "financial_caution", "protected_context", "unsafe_request", "crisis",
)
SCORED_DOMAINS = ("coding", "customer_support", "sales", "legal", "medical", "commerce", "education")
HIGH_VALUE_DOMAINS = ("coding", "customer_support", "sales")
PROTECTED_DOMAINS = ("medical", "legal")
NO_REUSE_DOMAINS = ("legal",)
HIGH_REUSE_DOMAINS = ("customer_support", "commerce", "education", "medical", "coding")

# --- fixed values: keyword groups (substring tests) ----------------------------------------

KEYWORD_GROUPS = {
    "coding": ["code", "function", "api", "auth", "login", "webhook", "typescript", "javascript", "python", "bug",
               "stack trace"],
    "support": ["order", "refund", "delivery", "arrived", "ticket", "support", "cancel", "replacement"],
    "sales": ["pricing", "price", "demo", "trial", "competitor", "objection", "contract", "plan", "subscription"],
    "legal": ["contract", "clause", "enforceable", "rights", "liable", "lawsuit", "tenant", "terms"],
    "medical": ["headache", "fever", "symptom", "doctor", "medication", "dose", "pain", "bleeding"],
    "commerce": ["buy", "purchase", "best under", "recommend", "where can i buy", "worth it", "₹", "$"],
    "education": ["teach", "learn", "quiz", "explain like", "homework", "study", "lesson"],
    "urgency": ["urgent", "asap", "today", "now", "immediately", "2 weeks", "still not", "keeps failing"],
    "crisis": ["kill myself", "end my life", "want to die", "don't want to be here", "self harm"],
    "unsafe": ["hack into", "steal", "bypass security", "malware", "phishing"],
}
AFFECT_WORDS = {
    "frustrated": ["stupid", "annoying", "frustrated", "keeps failing", "broken", "hate this"],
    "distressed": ["hopeless", "worthless", "empty", "panic", "overwhelmed", "alone"],
    "positive": ["great", "awesome", "love", "excited", "perfect"],
}

# --- fixed values: structure tests on the current turn (case-insensitive) -------------------

STRUCTURE_RULES = {
    "code_block": raw(r"```[\s\S]*```", (r"```[\s\S]*```", ("```",))),
    "error_signal": terms("error", "exception", "traceback", "undefined", "null pointer", "401", "403", "500"),
    "comparison_marker": terms("vs", "versus", "compare", "difference between"),
    "date_or_schedule": raw(
        r"\b\d{1,2}[/-]\d{1,2}\b|\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|next week)\b",
        (r"\b\d{1,2}[/-]\d{1,2}\b", ()),
        phrases=("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tomorrow", "next week"),
    ),
    "price_constraint": raw(
        r"[₹$]\s?\d+|\bunder\s+[₹$]?\d+", (r"[₹$]\s?\d+|\bunder\s+[₹$]?\d+", ("₹", "$", "under"))
    ),
}

# --- fixed values: rules on the whole context (all turns so far) ----------------------------

CONTEXT_RULES = {
    "self_harm": terms("i do not want to be here", "i don't want to be here", "want to die", "kill myself", "self harm"),
    "tone_edit": terms("correct the tone", "email shorter", "delayed launch"),
    "hosting": terms("cheaper hosting", "hosting option", r"next\.js mvp"),
    "support_verb": terms("refund", "order", "damaged", "replacement", "tracking", "delivery", "escalate?", "arrived",
                          "fulfil"),
    "order_reference": raw(
        r"\b(order\s*#?|ord-|cst-|ticket|#[a-z0-9]{4,})\b",
        (r"\b(order\s*#?|ord-|cst-|ticket|#[a-z0-9]{4,})\b", ("ord", "cst-", "ticket", "#")),
    ),
    "device": terms("macbook", "thinkpad", "iphone", "samsung", "s24", "laptop", "tablet", "headphones"),
    "stack": terms("migration", "nullable", "backfill", "constraints", "webhook", "stripe", "worker", "typescript",
                   "redis", "postgres(?:ql)?", "postgresql", "gcp", "docker", "kubernetes", "k8s", "fastapi", "django",
                   "rails"),
    "deal": terms("discount", "premium", "roi", "soc2", "discussed discount"),
    "budget": terms("budget"),
    "technical": terms("postgres(?:ql)?", "python", "gcp", "aws", "azure", "database", "api", "code", "script", "deploy",
                       "server", "instance"),
    "legal_advice": terms("advice", "clause", "contract", "termination", "non-compete", "indemnity", "liable", "lawsuit",
                          "tenant", "rights", "counsel"),
    "build_work": terms("write", "create", "generate", "build", "scrape", "csv", "selector", "beautifulsoup",
                        "pagination", "implement"),
    "fault_work": terms("final fix", "fix for that issue", "why is", "error", "failed", "timeout", "500", "401", "403",
                        "bug", "migration"),
    "product_choice": terms("which one", "better battery", "compare", "versus", "vs", "iphone", "samsung"),
    "summary_topic": terms("summary", "summarize", "recap"),
    "care_question": terms("what should", "doctor", "readings", "side effects", "bp", "blood pressure"),
    "deal_topic": terms("send me the contract", "discount", "security", "not sure", "concern", "objection"),
    "support_topic": terms("refund", "process", "exactly when", "arrived", "called", "escalate"),
    "support_escalation": terms("escalate", "escalated", "already called", "no one helped", "3 weeks", "full refund",
                                "want a refund", "refund now", "not here"),
    "crisis_phrase": terms("kill myself", "end my life", "want to die", "self harm", "following me",
                           "do not want to be here", "don't want to be here", "not want to be here anymore"),
    "unsafe_phrase": terms("hack into", "steal", "bypass security", "malware", "phishing", "exploit", "delete logs",
                           "delete the logs", "hide the evidence", "nobody can trace", "evade"),
    "unresolved_call": terms("already called", "no one helped", "not here by friday", "shortness of breath"),
}

# --- fixed values: rules on the current turn ------------------------------------------------

CURRENT_RULES = {
    "teaching": terms("quiz", "teach", "learn", "explain", "study"),
    "scheduling": terms("schedule", "calendar", "next item", "meeting"),
    "clinical": terms("doctor", "bp readings", "blood pressure"),
    "contract": terms("termination", "contract", "clause"),
    "legal_word": terms("legal"),
    "support_word": terms("refund", "order", "delivery", "ticket"),
    "generic_reference": terms("that issue", "that problem", "this issue", "that one", "which one", "discussed",
                               "the process", "next item"),
    "cover_up": terms("delete the logs", "hide the evidence", "nobody can trace"),
    "confirm": terms("is that ok", "confirm", "are you sure", "does this look right"),
    "failure": terms("failing", "throws", "crashes?", "crashing", "broken", "bug", "fix this", "recursion",
                     "recursionerror", "typeerror", "syntaxerror", "valueerror", "attributeerror", "importerror"),
    "compare": terms("compare", "vs", "versus", "difference between", "better than"),
    "summarize": terms("summarize", "tl;dr", "tldr", "key points"),
    "review": terms("quiz", "recap", "summarize"),
    "correct_text": terms("correct the tone", "make this email shorter", "correct this", "fix my wording"),
    "produce": terms("write", "create", "generate", "build", "draft", "make me", "implement"),
    "safety_question": terms("is it safe", "safe to", "should i keep", "taking .* every day"),
    "legal_choice": terms("should i", "proceed", "termination", "options", "what can i do"),
    "decide": terms("should i", "help me decide", "which should", "recommend whether"),
    "deal_forward": terms("send", "proceed", "go with", "upgrade", "proposal", "submit", "sign"),
    "deal_doubt": terms("not sure", "concern", "security really", "too expensive", "hesitant", "half the price"),
    "disagree": terms("is this right", "correct this", "fix my wording", "actually", "no,", "that's wrong"),
    "when_status": terms("when", "status", "exactly"),
    "next_lesson": terms("quiz", "what's the next", "next item"),
    "schedule_task": terms("next item on my schedule", "calendar", "schedule"),
    "question": terms("why", "how", "what", "who", "when", "where"),
    "ideas": terms("ideas", "brainstorm", "explore", "options", "ways to"),
    "hesitation": terms("not sure", "too expensive", "concerned", "hesitant", "maybe later"),
    "resolve_now": terms("refund", "resolve", "escalate", "manager"),
    "alarm": terms("i do not want to be here", "i don't want to be here", "want to die", "self harm", "delete the logs",
                   "hide the evidence", "nobody can trace"),
    "thanks": terms("thanks", "that helps", "done", "resolved", "wrap up", "that's all"),
    "persistence": terms("still", "keeps", "not fixed", "2 weeks", "asap", "urgent"),
    "conclude": terms("so", "therefore", "choose", "ship", "submit"),
    "act": terms("send the", "go with", "proceed with", "recommend the", "final fix", "send me the contract"),
    "new_topic": terms("ok now", "next topic", "new topic", "different question", "switching to"),
    "back_reference": terms("as i said", "from before", "coming back", "earlier", "that issue", "discussed",
                            "which one was that"),
}
SMALL_TALK = terms("weather", "cat", "dark mode", "space travel", "cricket")

# --- fixed values: score patterns on the context ---------------------------------------------

SCORE_RULES = {
    "coding": terms("code", "function", "api", "auth", "login", "webhook", "typescript", "javascript", "python", "bug",
                    "error", "exception", "traceback", "undefined", "401", "403", "500", "sql", "database", "schema",
                    "migration", "docker", "react", "node", "csv", "beautifulsoup", "selector", "pagination"),
    "customer_support": raw(
        r"\b(order|refund|delivery|arrived|ticket|support|cancel|replacement|tracking|logistics)\b|#\d+",
        (r"#\d+", ("#",)),
        phrases=("order", "refund", "delivery", "arrived", "ticket", "support", "cancel", "replacement", "tracking",
                 "logistics")),
    "sales": terms("pricing", "price", "demo", "trial", "competitor", "objection", "contract", "plan", "subscription",
                   "discount", "annual", "premium", "soc2", "security", "startup", "startups"),
    "legal": terms("contract", "clause", "enforceable", "rights", "liable", "lawsuit", "tenant", "terms", "termination",
                   "employee", "employer", "retaliation", "whistleblower", "at-will", "california", "legal", "policy",
                   "documentation"),
    "medical": terms("headache", "fever", "symptom", "symptoms", "doctor", "medication", "prescription", "dose",
                     "dosage", "pain", "bleeding", "bp", "blood pressure", "heart rate", "resting heart rate", "bpm",
                     "cough", "dizziness", "dizzy", "lightheaded", "light-headed", "faint", "fainting", "nausea", "rash",
                     "swelling", "side effect", "side effects", "stop taking", "since starting", "new medication"),
    "commerce": raw(
        r"\b(buy|purchase|best under|recommend|where can i buy|worth it|iphone|samsung|s24|battery|msrp|laptop|monitor"
        r"|keyboard|standing desk)\b|[₹$]\s?\d+",
        (r"[₹$]\s?\d+", ("₹", "$")),
        phrases=("buy", "purchase", "best under", "recommend", "where can i buy", "worth it", "iphone", "samsung", "s24",
                 "battery", "msrp", "laptop", "monitor", "keyboard", "standing desk")),
    "education": terms("teach", "learn", "quiz", "explain", "homework", "study", "lesson", "process", "steps",
                       "flashcard", "example"),
}

# --- fixed values: off-topic patterns and turn relevance --------------------------------------

DISTRACTORS = ("dark mode", "light mode", "marvel", "movie", "weather", "tokyo", "cat", "lunch", "space travel",
               "favorite color", "standing desk", "fitness routine", "sushi", "burger")
EXTRA_DISTRACTORS = (
    (r"\bwhat(?:'s| is) the weather\b", 3),
    (r"\bwhat(?:'s| is) your favorite\b", 3),
    (r"\brandom thought\b", 2),
)
ON_TOPIC = terms("500", "401", "403", "refund", "order", "security", "soc2", "doctor", "blood pressure", "lisinopril",
                 "calvin cycle", "binary search")

DOMAIN_PATTERNS = {
    "coding": r"```[\s\S]*?```|`[^`\n]{3,}`|\b(error|exception|function|api|auth|[45]\d{2}|database|schema|migration"
              r"|timeout|stripe|signature|secret|worker|queue|retry|dead-letter|redis|postgres|payment|TypeError"
              r"|SyntaxError|ReferenceError|requests|bio)\b|\/[a-z0-9/_-]+",
    "customer_support": r"\b(order|refund|delivery|tracking|escalate|escalated|express shipping|damaged|replacement"
                        r"|process)\b|#\w+|[A-Z]{1,4}[-_]?\d{3,}|\d{6,}",
    "sales": r"\$[\d,]+|\bQ[1-4]\b|\b(price|discount|premium|security|soc2|encryption|startup|budget|roi|manager|sso"
             r"|audit logs|contract|end of month|end of quarter|per month|per year)\b",
    "legal": r"\b(contract|clause|termination|retaliation|whistleblower|at-will|california|indemnity"
             r"|third-party claims|india|non-compete|documentation)\b",
    "medical": r"\b(doctor|bp|blood pressure|ibuprofen|lisinopril|chest|tightness|shortness of breath"
               r"|stomach discomfort|knee pain|cough|side effects)\b",
    "commerce": r"\b(thinkpad|macbook|iphone|samsung|s24|battery|docker|next\.js|postgresql|hosting|vercel|netlify"
                r"|msrp|ios|android)\b",
    "education": r"\b(quiz|process|summary|photosynthesis|chlorophyll|calvin cycle|binary search|sorted array"
                 r"|middle item)\b",
    "general": r"\b(calendar|schedule|meeting|maya|email|launch|tone|pressure|safe)\b",
}
OTHER_DOMAIN_PATTERN = r"\w+"
STRUCTURE_BOOSTS = {
    "coding": (r"(?i)```[\s\S]*?```|`[^`\n]{3,}`|\b(?:TypeError|SyntaxError|ReferenceError|ValueError|RuntimeError"
               r"|AttributeError):", 4),
    "customer_support": (r"(?i)\b[A-Z]{1,4}[-_]?\d{3,10}\b|\border\s*#?\s*[A-Z0-9]{4,}\b", 4),
    "sales": (r"(?i)\$[\d,]+|Q[1-4]|end of (?:month|quarter|year)", 4),
    "medical": (r"\b\d{2,3}\/\d{2,3}\b", 3),
}
ACTION_BOOSTS = {
    "coding": (terms("failed", "error", "timeout", "issue", "fix", "migration", "schema", "column", "requests", "api",
                     "endpoint", "lock", "retry"), 3),
    "customer_support": (terms("refund", "tracking", "arrived", "damaged", "replacement", "process", "escalat",
                               "delivery"), 3),
    "sales": (terms("discount", "budget", "security", "roi", "contract", "annual", "price", "premium"), 3),
    "medical": (terms("side effects", "blood pressure", "doctor", "cough", "safe", "stop taking", "persistent"), 3),
    "legal": (terms("contract", "termination", "retaliation", "indemnity", "clause", "documentation", "non-compete"), 3),
    "education": (terms("explain", "summary", "quiz", "process", "example", "binary search", "photosynthesis"), 2),
    "commerce": (terms("compare", "budget", "battery", "hosting", "buy", "worth", "cheaper"), 2),
    "general": (terms("meeting", "email", "calendar", "schedule", "launch", "deadline"), 2),
}

# --- fixed values: fact patterns, in collection order ----------------------------------------

FACT_PATTERNS = {
    "coding": (
        r"(?i)\bStripe|TypeScript|Python|Redis|PostgreSQL|Postgres|BeautifulSoup|CSV|Docker|Next\.js|API key|requests"
        r"|webhook|signature|secret|worker|queue|retry|dead-letter|rate limiting|latency|concurrency|migration|backfill"
        r"|nullable|exponential backoff|database|schema|scrape|pagination|bio\b",
        r"(?i)\b(?:TypeError|SyntaxError|ReferenceError|ValueError|RuntimeError|AttributeError):\s*[^\n]{0,80}",
        r"(?i)\bError:\s*[^\n]{0,80}",
        r"\b[45]\d{2}\s+[A-Za-z ]{3,30}",
        r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b",
        r"\b[a-z][a-z0-9]*(?:_[a-z][a-z0-9]+){1,}\b",
        r"(?i)\b[a-z]+(?:-[a-z0-9]+)+\b",
        r"(?i)\b(?:src|lib|app|components|pages|api|utils|routes|models)\/[a-z0-9/_.-]+",
        r"""['"][A-Za-z_][A-Za-z0-9_-]{1,40}['"]""",
        "CODE_BLOCK",
        r"`[^`\n]{3,60}`",
    ),
    "customer_support": (
        r"(?i)\brefund|delivery|tracking|express shipping|damaged|replacement|escalated?|process\b",
        r"\b[A-Z]{1,4}[-_]?\d{3,10}\b",
        r"(?i)\border\s*#?\s*[A-Z0-9]{4,}\b",
        r"\b\d{6,12}\b",
        r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?\b",
        r"\b\d{1,2}\/\d{1,2}(?:\/\d{2,4})?\b",
        r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b",
    ),
    "sales": (
        r"(?i)\bpremium plan|premium|startup discount|ROI|SOC2|SSO|audit logs|security features|budget|discount"
        r"|contract\b",
        r"\$[\d,]+(?:\.\d{2})?(?:\s*(?:k|K|M|B|million|thousand))?\b",
        r"(?i)\b\d+(?:,\d{3})*\s*(?:dollars?|USD)\b",
        r"(?i)\b\d+\s*(?:per\s+(?:month|year|seat|user)|\/mo|\/yr|\/user)\b",
        r"(?i)\bQ[1-4]\s*(?:\d{4})?\b",
        r"(?i)\bend\s+of\s+(?:month|quarter|year|week)\b",
        r"(?i)\bnext\s+(?:week|month|quarter|year)\b",
    ),
    "legal": (
        r"(?i)\bindemnity clause|third-party claims|California law|California|non-compete|18 months|India|retaliation"
        r"|whistleblower|at-will|contract|documentation|performance\b",
    ),
    "medical": (
        r"(?i)\bchest tightness|shortness of breath|two days|three weeks|ibuprofen|daily|knee pain|stomach discomfort"
        r"|blood pressure|doctor|Lisinopril|cough|side effects\b",
        r"\b\d{2,3}\/\d{2,3}\b",
    ),
    "commerce": (
        r"(?i)\bThinkPad T14|MacBook Air M3|iPhone|Samsung|S24 Ultra|S24|battery|Docker|Next\.js MVP|PostgreSQL"
        r"|500 users|cheaper hosting|MSRP|iOS|Android\b",
    ),
    "education": (
        r"(?i)\bphotosynthesis|Calvin cycle|chlorophyll|glucose|binary search|sorted array|middle item|left or right"
        r"|oxygen|sunlight\b",
    ),
    "general": (
        r"(?i)\bcalendar|Maya|Sarah|meeting|email|delayed launch|API integration|pressure|failing everyone|safe\b",
    ),
}
COMMON_FACT_PATTERNS = (
    r"#[A-Z]?\d+",
    r"(?i)\/[a-z][a-z0-9/_-]*",
    r"(?i)\b\d+\s*(?:ms|gb|mb|%|rpm|rps|req)\b",
)
CONSTRAINT_PATTERNS = (
    r"(?i)\b\d+(?:am|pm|ms|gb|mb|%)\b",
    r"(?i)\b\d+\s+(?:requests?|users?|days?|weeks?|months?|rows?)\b",
    r"(?i)\bunder\s+\d+\b",
    r"#[A-Z]?\d+",
)
DOMAIN_CONSTRAINTS = {
    "coding": r"(?i)\bexponential backoff|dead-letter|raw body|API key|nullable|backfill|constraints|10 million rows|CSV"
              r"|pagination|script\b",
    "customer_support": r"(?i)\bexpress shipping|last Monday|this morning|damaged monitor\b",
    "sales": r"(?i)\bstartup discount|annual plans?|budget|ROI|SOC2|SSO|audit logs|20% discount\b",
    "legal": r"(?i)\bCalifornia law|California|at-will|18 months|third-party claims|documentation\b",
    "medical": r"(?i)\btwo days|three weeks|every day|140\/90|side effects|persistent cough\b",
    "commerce": r"(?i)\b1200 dollars|500 users|battery life\b",
    "education": r"(?i)\bCalvin cycle|sorted array|middle item\b",
    "general": r"(?i)\b10am|1pm|5pm|6pm|after lunch|lunch|gym\b",
}
# guard on the lower-cased text (None: always), then the items to collect
UNRESOLVED_PATTERNS = {
    "coding": (r"\b403|401|500|failed|timeout|signature|schema|bio|requests\b",
               r"(?i)\b403|401|500|signature|timeout|failed payment|card_declined|retry_count|rate limiting|latency"
               r"|schema|bio|requests\b"),
    "customer_support": (r"\brefund|arrived|tracking|escalate|process\b",
                         r"(?i)\brefund|arrived|tracking|Dallas|Chicago|escalated?|process\b"),
    "sales": (r"\bprice|budget|security|discount|contract\b",
              r"(?i)\bprice|budget|security|discount|ROI|SSO|audit logs|contract\b"),
    "legal": (r"\bsign|risk|termination|non-compete|retaliation\b",
              r"(?i)\bindemnity clause|non-compete|termination|retaliation|whistleblower\b"),
    "medical": (r"\bchest|shortness of breath|safe|ibuprofen|lisinopril|cough|blood pressure\b",
                r"(?i)\bchest tightness|shortness of breath|ibuprofen|stomach discomfort|Lisinopril|cough|blood pressure"
                r"|140\/90\b"),
    "commerce": (r"\bbetter|cheaper|battery\b", r"(?i)\bThinkPad T14|MacBook Air M3|cheaper|battery\b"),
    "education": (r"\bquiz\b", r"(?i)\bCalvin cycle|binary search|sorted array|middle item|left or right\b"),
    "general": (None, r"(?i)\bMaya|gym|email|after lunch|delayed launch|API integration\b"),
}
IMPORTANT_FACTS = {
    "coding": r"(?i)\b(403|401|500|Stripe|TypeScript|Python|Redis|Postgres|signature|webhook|dead-letter|card_declined"
              r"|retry_count|rate limiting|latency|concurrency|100 requests|API key|exponential backoff|nullable"
              r"|backfill|constraints|migration|queue|retry|worker|database|schema|scrape|pagination|script|requests"
              r"|bio|BeautifulSoup|CSV)\b",
    "customer_support": r"(?i)\b(Dallas|Chicago|refund|delivery|express shipping|damaged monitor|replacement"
                        r"|escalated?|tracking|order|Friday|Monday|deadline|process)\b",
    "sales": r"(?i)\b(ROI|SOC2|SSO|audit logs|discount|security|premium|startups|contract|budget)\b",
    "legal": r"(?i)\b(indemnity clause|third-party claims|non-compete|California law|California|whistleblower|contract"
             r"|18 months|termination|India|retaliation|documentation|performance)\b",
    "medical": r"(?i)\b(chest tightness|shortness of breath|ibuprofen|stomach discomfort|two days|three weeks|daily"
               r"|knee pain|blood pressure|doctor|Lisinopril|cough|side effects|140\/90)\b",
    "commerce": r"(?i)\b(ThinkPad T14|MacBook Air M3|PostgreSQL|Next\.js MVP|iPhone|Samsung|S24 Ultra|S24|battery|MSRP"
                r"|iOS|Android)\b",
    "education": r"(?i)\b(Calvin cycle|binary search|sorted array|middle item|photosynthesis|chlorophyll|glucose"
                 r"|left or right|oxygen|sunlight)\b",
    "general": r"(?i)\b(Maya|Sarah|API integration|delayed launch|failing everyone|calendar|email|pressure|safe"
               r"|meeting)\b",
}

# hard facts, in collection order; group 1 is taken where the last number says so
HARD_FACT_PATTERNS = (
    (r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?"
     r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?\b", None, 0),
    (r"\b\d{4}-\d{2}-\d{2}\b", None, 0),
    (r"\b([A-Z][a-z]{1,20})(\s+(?:of\s+)?[A-Z][a-z]{1,20}){1,3}\b", None, 0),
    (r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:ms|GB|MB|TB|KB|%|rpm|rps|USD|dollars?|kg|km|mi|mph))\b", None, 0),
    (r"\b(?:\+?\d[\d\s\-().]{7,15}\d)\b", None, 0),
    (r"\b[A-Z]{1,5}[-_]?\d{3,12}\b", None, 0),
    (r"(?i)\$[\d,]+(?:\.\d{2})?(?:\s*(?:k|M|B|million|thousand))?\b", None, 0),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:was|is|are|were|did|has|have|began|started|founded|built|hired"
     r"|located)\b", "education", 1),
    (r"\b\d{2,3}\/\d{2,3}\b", "medical", 0),
    (r"\b[A-Z][a-z]+(?:cin|pril|olol|statin|zide|pine|mide)\b", "medical", 0),
)

# --- fixed values: prompt policy --------------------------------------------------------------

INTENT_POLICY = {
    "information_seeking": "Answer the question directly, then add only necessary context.",
    "task_execution": "Turn the request into concrete next actions and complete the requested task shape.",
    "decision_support": "Compare against the user criteria and end with a clear recommendation.",
    "comparison": "Use consistent criteria across options and call out the practical winner.",
    "summarization": "Preserve meaning while removing everything nonessential.",
    "generation": "Produce the requested artifact first, with concise explanation after.",
    "debugging": "Identify the most likely root cause first, then give the smallest useful fix.",
    "escalation": "Acknowledge the rising urgency and move toward resolution quickly.",
    "objection_handling": "Surface the concern, answer it specifically, and avoid pressure.",
    "confirmation_seeking": "Confirm, correct, or qualify clearly with minimal extra detail.",
    "exploration": "Generate several distinct directions without prematurely judging them.",
    "correction": "Point out the correction plainly and provide the fixed version.",
}
STATE_POLICY = {
    "opening": "Establish the frame quickly because there is little prior context.",
    "deepening": "Build on the existing topic without repeating basics.",
    "pivoting": "Recognize the topic shift and reset only the relevant context.",
    "returning": "Reconnect to earlier context and avoid making the user restate it.",
    "escalating": "Prioritize speed, clarity, and immediate next steps.",
    "resolving": "Move toward a concrete conclusion or handoff.",
    "closing": "Be brief and close the loop cleanly.",
}
DOMAIN_POLICY = {
    "general": "Use general assistant language and avoid domain-specific assumptions.",
    "coding": "Preserve technical details, exact errors, file names, APIs, and constraints.",
    "customer_support": "Track issue state, requested resolution, and customer frustration signals.",
    "sales": "Stay helpful and consultative; do not overpromise or pressure the user.",
    "legal": "Provide general legal information only and recommend qualified counsel for decisions.",
    "medical": "Provide health information only and encourage professional care for concerning symptoms.",
    "education": "Teach progressively and check understanding before increasing complexity.",
    "commerce": "Respect budget and preferences; give specific tradeoffs and avoid fake certainty.",
}
OTHER_DOMAIN_POLICY = "Use the active custom domain rules and avoid unsupported assumptions."
RISK_POLICY = (
    ("crisis", "Crisis risk is present: prioritize immediate safety and supportive next steps."),
    ("medical_caution", "Do not diagnose; flag urgent symptoms and encourage professional care."),
    ("legal_caution", "Do not provide legal advice; explain concepts and jurisdiction limits."),
    ("financial_caution", "Do not guarantee financial outcomes or imply certainty."),
    ("unsafe_request", "Refuse unsafe assistance and offer a safe alternative."),
)
DEMO_PROMPTS = {
    "coding": "You are a senior software engineer. Give concise, accurate technical help. Use code snippets when useful. "
              "Be direct and practical.",
    "medical": "You are a knowledgeable medical information assistant. Provide clear general health information. Always "
               "recommend consulting a qualified doctor for personal medical decisions.",
    "legal": "You are a legal information assistant. Explain legal concepts clearly and simply. Always clarify this is "
             "general information, not legal advice.",
    "sales": "You are a helpful sales consultant. Understand the customer's needs honestly and provide relevant, "
             "trustworthy recommendations.",
    "customer_support": "You are a friendly, efficient customer support agent. Focus on resolving issues quickly and "
                        "empathetically.",
    "education": "You are a patient, clear teacher. Break complex topics into understandable steps and use relatable "
                 "examples.",
    "commerce": "You are a knowledgeable shopping assistant. Help users compare options and make informed purchase "
                "decisions.",
    "general": "You are a helpful, knowledgeable assistant. Give clear, accurate, and concise responses.",
}
DOMAIN_LEADS = {
    "coding": "The user is working on a technical issue. Current request: ",
    "customer_support": "The user needs customer support help. Current request: ",
    "sales": "The conversation is in a sales motion. Current request: ",
    "legal": "The user is asking for legal-adjacent guidance. Current request: ",
    "medical": "The user is asking for medical-adjacent guidance. Current request: ",
    "education": "The user is learning or reviewing material. Current request: ",
    "commerce": "The user is comparing or selecting a purchase option. Current request: ",
}
OTHER_DOMAIN_LEAD = "The active task is: "

# The product label that appears in generated texts. It is a parameter: three characters,
# so token estimates do not depend on the choice.
LABEL = "CTX"


@dataclass(frozen=True)
class Vocabulary:
    """The complete set of rules the classifier and the turn scorer work with."""

    keyword_groups: dict = field(default_factory=lambda: KEYWORD_GROUPS)
    affect_words: dict = field(default_factory=lambda: AFFECT_WORDS)
    structures: dict = field(default_factory=lambda: STRUCTURE_RULES)
    context: dict = field(default_factory=lambda: CONTEXT_RULES)
    current: dict = field(default_factory=lambda: CURRENT_RULES)
    scores: dict = field(default_factory=lambda: SCORE_RULES)
    small_talk: Rule = SMALL_TALK
    domain_patterns: dict = field(default_factory=lambda: DOMAIN_PATTERNS)
    structure_boosts: dict = field(default_factory=lambda: STRUCTURE_BOOSTS)
    action_boosts: dict = field(default_factory=lambda: ACTION_BOOSTS)
    distractors: tuple = DISTRACTORS
    extra_distractors: tuple = EXTRA_DISTRACTORS
    on_topic: Rule = ON_TOPIC
    fact_patterns: dict = field(default_factory=lambda: FACT_PATTERNS)
    common_facts: tuple = COMMON_FACT_PATTERNS

    def with_(self, **changes) -> "Vocabulary":
        return replace(self, **changes)


DEFAULT = Vocabulary()
