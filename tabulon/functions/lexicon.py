"""Fixed values of the search: word lists that results depend on, so they are stated as they are."""

from __future__ import annotations

# Words that a query's words are searched without.
STOP_WORDS = ("the", "and", "for", "with", "from", "into", "about", "this", "that", "have", "has", "had", "are", "was", "were", "or", "but")

# Groups of terms that stand for one another.
SYNONYMS = (
    ("revenue", "revenues", "sales", "营业收入", "營業收入"),
    ("net income", "net profit", "净利润", "淨利潤"),
    ("cash flow", "现金流", "現金流"),
    ("risk", "risks", "risk factors", "风险", "風險"),
    ("guidance", "outlook", "指引", "展望"),
    ("share repurchase", "repurchase", "buyback", "回购", "回購"),
    ("board of directors", "board", "董事会", "董事會"),
    ("management", "executive officers", "管理层", "管理層"),
    ("legal proceedings", "litigation", "诉讼", "訴訟"),
    ("compete", "competition", "competitor", "competitive", "competitiveness"),
    ("market share", "market position", "market penetration"),
    ("monopoly", "dominant position", "market dominance"),
    ("acquisition", "merger", "deal", "buyout", "takeover"),
    ("product", "offering", "solution", "service", "platform"),
    ("threat", "headwind", "challenge", "pressure"),
    ("intellectual property", "patent", "proprietary"),
    ("supply chain", "sourcing", "procurement", "vendor", "supplier"),
    ("customer retention", "churn", "loyalty"),
    ("profit", "profitability", "margin", "earnings"),
    ("operating income", "operating profit", "ebit"),
    ("debt", "borrowing", "leverage", "liabilities"),
    ("equity", "shareholders equity", "stockholders equity"),
    ("research and development", "r&d", "innovation"),
    ("regulation", "regulatory", "compliance"),
    ("dividend", "dividends", "distribution", "payout"),
)

# Words that say little of what is meant.
GENERIC = ("competition", "competitor", "competitive", "market", "business", "strategy", "policy", "growth", "performance", "management", "risk", "compliance")

# Words of each intent; the first of equal ones wins.
INTENTS = {
    "business_competition": ("competitor", "competition", "competitive", "market", "marketshare", "share", "customer", "industry", "peer", "supplier", "product", "service", "lithography", "semiconductor"),
    "financial": ("revenue", "income", "earnings", "cash", "margin", "asset", "liability", "equity", "guidance", "profit"),
    "governance": ("board", "director", "governance", "compensation", "executive", "committee", "ethics", "compliance", "anti", "bribery"),
    "people": ("employee", "talent", "hiring", "students", "competition", "league", "recruit", "workforce", "training", "employer"),
    "risk": ("risk", "threat", "uncertainty", "vulnerability", "cybersecurity", "litigation", "exposure"),
}

# Words around a hit that speak against an intent, and those that make up for it.
NOISE = {"business_competition": ("antitrust", "compliance", "ethics", "students", "league", "robotics", "employer", "universum", "human", "rights")}
SUPPORT = {"business_competition": ("market", "industry", "customer", "supplier", "peer", "product", "service", "technology", "lithography", "semiconductor")}

# The bucket of each topic of a section.
TOPIC_BUCKETS = {
    "business": "business",
    "company_information": "business",
    "properties": "business",
    "operating_review": "business",
    "risk_factors": "risk",
    "market_risk": "risk",
    "cybersecurity": "risk",
    "mda": "financial",
    "financial_statements": "financial",
    "financial_information": "financial",
    "selected_financial_data": "financial",
    "quantitative_disclosures": "financial",
    "key_information": "financial",
    "directors": "governance",
    "governance": "governance",
    "executive_compensation": "governance",
    "security_ownership": "governance",
    "certain_relationships": "governance",
    "principal_accountant": "governance",
    "controls_procedures": "governance",
    "directors_employees": "people",
    "legal_proceedings": "legal",
    "exhibits": "other",
    "signature": "other",
    "mine_safety": "other",
    "other_information": "other",
    "unresolved_staff_comments": "other",
    "offer_listing": "other",
    "additional_information": "other",
    "market_for_equity": "financial",
    "securities_description": "other",
    "defaults_arrearages": "other",
    "material_modifications": "other",
    "changes_disagreements": "other",
}

# Words that put a section without a known topic into a bucket; the first of equal ones wins.
BUCKET_WORDS = {
    "business": ("business", "operating", "market", "product", "service", "customer", "industry", "company", "overview", "operations"),
    "risk": ("risk", "risks", "threat", "uncertainty", "cybersecurity"),
    "financial": ("financial", "income", "revenue", "earnings", "assets", "liabilities", "equity", "cash", "mda", "discussion", "analysis", "quantitative"),
    "governance": ("governance", "director", "directors", "compensation", "committee", "board", "audit", "shareholder", "ethics"),
    "people": ("employee", "employees", "workforce", "personnel", "staff", "talent", "headcount"),
    "legal": ("legal", "proceeding", "proceedings", "litigation", "lawsuit", "compliance"),
}

# Buckets that an intent looks in first.
INTENT_BUCKETS = {
    "business_competition": ("business", "risk", "financial"),
    "financial": ("financial", "business"),
    "governance": ("governance", "legal", "people"),
    "people": ("people", "governance"),
    "risk": ("risk", "legal", "business"),
}
