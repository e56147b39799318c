"""Fixed values of billing (must match the reference)."""

# Tool-call cost per tool, in the order the tools are listed.
TOOL_COSTS = (
    ("sources.connect", 1), ("sources.list", 0), ("sources.test", 0),
    ("data.query", 2), ("data.fetch", 1), ("data.search", 2),
    ("pipeline.clean", 2), ("pipeline.deduplicate", 1), ("pipeline.redact_pii", 1),
    ("context.build", 3), ("context.summarize", 2), ("credits.check_balance", 0),
)
# Credit packs (credits -> price in cents), price of a credit outside packs in
# dollars, free credits granted at sign-up.
CREDIT_PACKS = ((100, 800), (500, 3000), (1000, 5000), (5000, 20000), (10000, 40000))
PER_CREDIT_USD = 0.08
FREE_CREDITS = 25
