"""Filing forms: names, document types, items and what they are about. The tables are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other ways to write a form, without spaces and in upper case.
FORM_NAMES = {
    "10K": "10-K",
    "10Q": "10-Q",
    "8K": "8-K",
    "8KA": "8-K/A",
    "8K/A": "8-K/A",
    "20F": "20-F",
    "6K": "6-K",
    "DEF14A": "DEF 14A",
    "SCHEDULE13D": "SC 13D",
    "SCHEDULE13DA": "SC 13D/A",
    "SCHEDULE13D/A": "SC 13D/A",
    "SCHEDULE13G": "SC 13G",
    "SCHEDULE13GA": "SC 13G/A",
    "SCHEDULE13G/A": "SC 13G/A",
    "SC13D/G": "SC 13D/G",
    "SC13DG": "SC 13D/G",
    "SC13D": "SC 13D",
    "SC13DA": "SC 13D/A",
    "SC13D/A": "SC 13D/A",
    "SC13G": "SC 13G",
    "SC13GA": "SC 13G/A",
    "SC13G/A": "SC 13G/A",
}
BOTH_SCHEDULES, SCHEDULES = "SC 13D/G", ("SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A")

# Years that a form is looked back for, and the days of grace.
LOOKBACK_YEARS = {"10-K": 5, "20-F": 5, "10-Q": 1, "6-K": 1, "DEF 14A": 3, "8-K": 1, "8-K/A": 1, "SC 13D": 1, "SC 13D/A": 1, "SC 13G": 1, "SC 13G/A": 1}
GRACE_DAYS = 60

# What kind of document a form is, a period that stands for a form, and a material.
FORM_TYPES = {
    "10-K": "annual_report",
    "10-K/A": "annual_report",
    "20-F": "annual_report",
    "20-F/A": "annual_report",
    "10-Q": "quarterly_report",
    "10-Q/A": "quarterly_report",
    "6-K": "quarterly_report",
    "8-K": "current_report",
    "8-K/A": "current_report",
    "DEF 14A": "proxy",
    "SC 13G": "ownership",
    "SC 13G/A": "ownership",
    "SC 13D": "ownership",
    "SC 13D/A": "ownership",
}
PERIOD_TYPES = {"FY": "annual_report", "H1": "semi_annual_report", "Q1": "quarterly_report", "Q2": "quarterly_report", "Q3": "quarterly_report", "Q4": "quarterly_report"}
MATERIAL_TYPES = {"EARNINGS_CALL": "earnings_call", "EARNINGS_PRESENTATION": "earnings_presentation", "CORPORATE_GOVERNANCE": "corporate_governance"}
MATERIAL_NAMES = {"EARNING_CALLS": "EARNINGS_CALL", "EARNINGS_CALLS": "EARNINGS_CALL", "EARNING_PRESENTATIONS": "EARNINGS_PRESENTATION", "EARNINGS_PRESENTATIONS": "EARNINGS_PRESENTATION"}
# The order of periods within a year.
PERIOD_RANK = {"Q1": 1, "Q2": 2, "H1": 3, "Q3": 4, "Q4": 5, "FY": 6}

# Items of a form, their titles and topics.
ITEMS_10K = {
    "1": ("Business", "business"),
    "1A": ("Risk Factors", "risk_factors"),
    "1B": ("Unresolved Staff Comments", "unresolved_staff_comments"),
    "1C": ("Cybersecurity", "cybersecurity"),
    "2": ("Properties", "properties"),
    "3": ("Legal Proceedings", "legal_proceedings"),
    "4": ("Mine Safety Disclosures", "mine_safety"),
    "5": ("Market for Registrant's Common Equity", "market_for_equity"),
    "6": ("[Reserved]", "selected_financial_data"),
    "7": ("Management's Discussion and Analysis", "mda"),
    "7A": ("Quantitative and Qualitative Disclosures About Market Risk", "quantitative_disclosures"),
    "8": ("Financial Statements and Supplementary Data", "financial_statements"),
    "9": ("Changes in and Disagreements With Accountants", "changes_disagreements"),
    "9A": ("Controls and Procedures", "controls_procedures"),
    "9B": ("Other Information", "other_information"),
    "9C": ("Disclosure Regarding Foreign Jurisdictions", "other_information"),
    "10": ("Directors, Executive Officers and Corporate Governance", "directors"),
    "11": ("Executive Compensation", "executive_compensation"),
    "12": ("Security Ownership of Certain Beneficial Owners", "security_ownership"),
    "13": ("Certain Relationships and Related Transactions", "certain_relationships"),
    "14": ("Principal Accountant Fees and Services", "principal_accountant"),
    "15": ("Exhibits and Financial Statement Schedules", "exhibits"),
}
ITEMS_10Q_I = {
    "1": ("Financial Statements", "financial_statements"),
    "2": ("Management's Discussion and Analysis", "mda"),
    "3": ("Quantitative and Qualitative Disclosures About Market Risk", "quantitative_disclosures"),
    "4": ("Controls and Procedures", "controls_procedures"),
}
ITEMS_10Q_II = {
    "1": ("Legal Proceedings", "legal_proceedings"),
    "1A": ("Risk Factors", "risk_factors"),
    "2": ("Unregistered Sales of Equity Securities", "other_information"),
    "3": ("Defaults Upon Senior Securities", "other_information"),
    "4": ("Mine Safety Disclosures", "mine_safety"),
    "5": ("Other Information", "other_information"),
    "6": ("Exhibits", "exhibits"),
}
ITEMS_20F = {
    "1": ("Identity of Directors, Senior Management and Advisers", "directors"),
    "2": ("Offer Statistics and Expected Timetable", "offer_listing"),
    "3": ("Key Information", "key_information"),
    "4": ("Information on the Company", "company_information"),
    "4A": ("Unresolved Staff Comments", "unresolved_staff_comments"),
    "5": ("Operating and Financial Review and Prospects", "operating_review"),
    "6": ("Directors, Senior Management and Employees", "directors_employees"),
    "7": ("Major Shareholders and Related Party Transactions", "major_shareholders"),
    "8": ("Financial Information", "financial_information"),
    "9": ("The Offer and Listing", "offer_listing"),
    "10": ("Additional Information", "additional_information"),
    "11": ("Quantitative and Qualitative Disclosures About Market Risk", "market_risk"),
    "12": ("Description of Securities Other Than Equity Securities", "securities_description"),
    "13": ("Defaults, Dividend Arrearages and Delinquencies", "defaults_arrearages"),
    "14": ("Material Modifications to the Rights of Security Holders", "material_modifications"),
    "15": ("Controls and Procedures", "controls_procedures"),
    "16A": ("Audit Committee Financial Expert", "governance"),
    "16B": ("Code of Ethics", "governance"),
    "16C": ("Principal Accountant Fees and Services", "governance"),
    "16D": ("Exemptions from the Listing Standards for Audit Committees", "governance"),
    "16E": ("Purchases of Equity Securities by the Issuer", "governance"),
    "16F": ("Change in Registrant's Certifying Accountant", "governance"),
    "16G": ("Corporate Governance", "governance"),
    "16H": ("Mine Safety Disclosure", "governance"),
    "16I": ("Disclosure Regarding Foreign Jurisdictions", "governance"),
    "16J": ("Insider Trading Policies", "governance"),
    "17": ("Financial Statements", "financial_statements"),
    "18": ("Financial Statements", "financial_statements"),
    "19": ("Exhibits", "exhibits"),
}
# The first item of each part.
PARTS_10K = {"1": "I", "5": "II", "10": "III", "15": "IV"}
PARTS_20F = {"1": "I", "5": "II", "13": "III", "17": "IV"}
ITEM_PATTERN = r"(?i)\bitem\s+(16[A-J]|[1-9][0-9]?[A-C]?)\b"


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def form_name(raw: Column) -> Column:
    """A form as it is written officially; one that isn't known in upper case. Null for a blank one."""
    upper = F.upper(F.trim(raw))
    return F.when(upper != "", F.coalesce(lookup(FORM_NAMES, F.replace(upper, F.lit(" "), F.lit(""))), upper))


def expanded_forms(names: Column) -> Column:
    """Official names of the forms in an array, sorted and each once; both schedules at once stand for all four."""
    each = F.transform(names, lambda n: F.when(form_name(n) == BOTH_SCHEDULES, F.array(*map(F.lit, SCHEDULES))).otherwise(F.array(form_name(n))))
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(each))))


def split_forms(text: Column) -> Column:
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")


def window_start(form: Column, end: Column) -> Column:
    """First day of the window in which filings of a form are looked for."""
    return F.date_sub(F.add_months(end, -12 * lookup(LOOKBACK_YEARS, form)), GRACE_DAYS)


def document_type(form: Column, source_kind: Column) -> Column:
    upper = F.replace(F.upper(F.trim(form)), F.lit(" "), F.lit("_"))
    material = F.coalesce(lookup(MATERIAL_TYPES, F.coalesce(lookup(MATERIAL_NAMES, upper), upper)), F.lit("material"))
    name = form_name(form)
    return F.when(source_kind == "material", material).otherwise(F.coalesce(lookup(PERIOD_TYPES, name), lookup(FORM_TYPES, name), F.lit("other")))


def fiscal_period(form: Column, period: Column) -> Column:
    """A period is never made up from dates: only an annual form without one has the full year's."""
    return F.coalesce(period, F.when(form_name(form).isin("10-K", "20-F"), "FY"))


def item_number(title: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(title, ITEM_PATTERN, 1)), F.lit(""))


def quarterly_part(title: Column) -> Column:
    return F.when(F.upper(title).rlike(r"\bPART\s+I\b(?!\s*I)"), "I").when(F.upper(title).rlike(r"\bPART\s+II\b"), "II")


def semantic(title: Column, form: Column, parent: Column) -> Column:
    """struct<item, title, topic> of a section's title; of a quarterly form the parent, or the title itself, says which part."""
    item, name = item_number(title), F.upper(F.trim(form))
    part = quarterly_part(F.coalesce(parent, title))

    def of(k: int) -> Column:
        table = lambda t: lookup({i: e[k] for i, e in t.items()}, item)
        quarterly = F.when(part == "II", table(ITEMS_10Q_II)).when(part == "I", table(ITEMS_10Q_I)).otherwise(F.coalesce(table(ITEMS_10Q_I), table(ITEMS_10Q_II)))
        found = F.when(name.isin("10-Q", "10-Q/A"), quarterly).when(name.isin("10-K", "10-K/A"), table(ITEMS_10K)).when(name.isin("20-F", "20-F/A"), table(ITEMS_20F))
        return F.when(item.isNotNull(), found).when(title.rlike(r"(?i)\bsignatures?\b"), ("Signatures", "signature")[k])

    return F.struct(item.alias("item"), of(0).alias("title"), of(1).alias("topic"))


def part_of(item: Column, form: Column) -> Column:
    """The part of the form that an item is in."""
    number = F.regexp_extract(item, r"^\d+", 0).try_cast("int")

    def of(parts: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for first, part in parts.items():
            out = F.when(number >= int(first), part).otherwise(out)
        return out

    return F.when(F.upper(form).isin("10-K", "10-K/A"), of(PARTS_10K)).when(F.upper(form).isin("20-F", "20-F/A"), of(PARTS_20F))


def section_path(form: Column, item: Column, official: Column, title: Column, parents: Column) -> Column:
    """Part, parents from the root on that aren't parts, item, and title where the item's name doesn't hold it."""
    head = F.array_compact(F.array(F.concat(F.lit("Part "), part_of(item, form))))
    above = F.filter(parents, lambda p: p.isNotNull() & (p != "") & ~p.rlike(r"(?i)^\s*part\s+"))
    path = F.concat(head, above, F.array_compact(F.array(F.concat(F.lit("Item "), item))))
    shown = F.coalesce(official, title)
    last = F.when(F.size(path) > 0, F.get(path, F.size(path) - 1))
    return F.concat(path, F.array_compact(F.array(F.when(last.isNull() | ~F.contains(last, shown), shown))))
