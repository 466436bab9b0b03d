"""Labels, equivalences and word lists of the evaluated pipelines.

All tables in this module are fixed values that results depend on.
"""

from __future__ import annotations

# Contract families and their labels, in order.
SUBTYPE_LABELS = {
    "affiliate": "Affiliate Agreement", "agency": "Agency Agreement", "collaboration": "Collaboration / Cooperation Agreement",
    "co_branding": "Co-Branding Agreement", "consulting": "Consulting Agreement", "development": "Development Agreement",
    "distributor": "Distributor Agreement", "endorsement": "Endorsement Agreement", "franchise": "Franchise Agreement",
    "hosting": "Hosting Agreement", "ip": "IP Agreement", "joint_venture": "Joint Venture Agreement", "license": "License Agreement",
    "maintenance": "Maintenance Agreement", "manufacturing": "Manufacturing Agreement", "marketing": "Marketing Agreement",
    "non_compete_no_solicit": "Non-Compete / No-Solicit / Non-Disparagement Agreement", "outsourcing": "Outsourcing Agreement",
    "promotion": "Promotion Agreement", "reseller": "Reseller Agreement", "service": "Service Agreement",
    "sponsorship": "Sponsorship Agreement", "strategic_alliance": "Strategic Alliance Agreement", "supply": "Supply Agreement",
    "transportation": "Transportation Agreement",
}
UNKNOWN = "other"
# Folder names and the families they mean.
SUBTYPE_ALIASES = {
    "affiliate_agreements": "affiliate", "affiliate_agreement": "affiliate", "agency_agreements": "agency",
    "consulting_agreements": "consulting", "endorsement_agreement": "endorsement", "joint_venture_filing": "joint_venture",
    "license_agreements": "license", "non_compete_non_solicit": "non_compete_no_solicit",
}
# Families that count for one another.
EQUIVALENT = [("reseller", "distributor"), ("maintenance", "license"), ("development", "license"), ("affiliate", "joint_venture")]
EQUIVALENT_SUBCLASSES = [("mixed_cash_stock", "mixed_cash_stock_election")]
FAILURE_MODES = ["function_over_form", "other_fallback", "equivalent_family", "family_confusion"]
DOC_CLASSES = ["contract", "corporate_record", "due_diligence", "correspondence", "compliance_filing", "court_opinion", "merger_agreement"]
CONSIDERATIONS = ["all_cash", "all_stock", "mixed_cash_stock", "mixed_cash_stock_election", "other"]
CONSIDERATION_ALIASES = {
    "all cash": "all_cash", "all cash consideration": "all_cash", "cash": "all_cash", "all stock": "all_stock",
    "all stock consideration": "all_stock", "stock": "all_stock", "mixed cash and stock": "mixed_cash_stock",
    "mixed cash stock": "mixed_cash_stock", "mixed cash and stock election": "mixed_cash_stock_election",
    "mixed cash stock election": "mixed_cash_stock_election", "other": "other", "unspecified": "other", "none": "other",
}
YES_WORDS, NO_WORDS = ["y", "yes", "true", "1"], ["n", "no", "false", "0"]
TASK_KINDS = {
    "subtype": "subtype", "doc_class": "doc_class", "docclass": "docclass", "maud_docclass": "docclass", "maud_question": "maud_question",
    "legalbench": "legalbench", "multiclass": "multiclass", "court_opinion": "court_opinion", "chained": "chained", "contracteval": "contracteval",
}
NO_RELATED = "no related clause"
POSITIVE_DENOMINATOR = 1244
ERROR_PREFIX = "ERROR: "
# Words that are left out of names, of containment, and words for roles.
CORPORATE_SUFFIXES = [
    "INC", "INCORPORATED", "LLC", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC", "LLP", "LP", "PLLC", "PC", "PA", "ESQ",
    "ESQUIRE", "GMBH", "AG", "NV", "SA", "SARL", "BV", "PTY", "GROUP", "HOLDINGS", "TRUST",
]
STOPWORDS = [
    "the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "by", "as", "is", "be", "are", "with", "its", "their", "his", "her", "such",
    "hereof", "hereunder", "shall", "any", "all", "this", "that", "these", "those", "from", "between", "into", "upon", "under", "over",
]
ROLE_WORDS = [
    "shipper", "sponsor", "seller", "buyer", "company", "producer", "reseller", "licensee", "licensor", "party", "parties", "transporter",
    "customer", "client", "vendor", "purchaser", "lender", "borrower", "guarantor", "manufacturer", "distributor", "owner", "operator",
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Number words of durations, and days of their units.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "twentyfour": 24, "twenty-four": 24, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "onehundred": 100, "hundred": 100,
}
DAYS_PER = {"year": 365, "month": 30, "week": 7, "day": 1}
# Words in a field's name that tell its type.
MONEY_HINTS = ["value", "amount", "fee", "compensation", "price", "cost", "salary", "consideration", "total"]
ID_HINTS = ["number", "id", "docket", "reference", "filing"]

# Tasks of run records.
SORTER_TASK, EXTRACTION_TASK = "subtype_classification", "contract_entity_extraction"
