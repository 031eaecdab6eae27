"""Row types of the engine's tables, as DDL, and the closed vocabularies of their columns."""

from __future__ import annotations

ANCHOR = "struct<circular_no:string,circular_date:date,intermediary:string,block:string,part:string,section_no:int,section_title:string,clause_path:string,page:int,char_start:bigint,char_end:bigint>"
DEADLINE = "struct<offset:bigint,unit:string,relative_to:string,fixed_date:date>"

PAGES = ("doc_id string, page_no int, text string, tables array<array<array<string>>>")
SECTION_INDEX = ("doc_id string, block string, part string, section_no int, title string, start_page int")
SECTION_SPANS = ("doc_id string, part string, section_no int, title string, start_page int, char_start bigint, char_end bigint, heading string, match_score double")
CLAUSES = ("doc_id string, clause_id string, section_no int, part string, clause_path string, page int, char_start bigint, char_end bigint, text string")
CHANGE_ENTRIES = ("s_no int, description string, page_para_ref string, source_circular_no string, referenced_pages array<int>, referenced_paras array<string>")
APPENDIX_ENTRIES = ("s_no int, circular_no string, circular_date string, subject string, status string")
COVERAGE_GAPS = ("doc_id string, page int, reason string, detail string")
HEADERS = ("doc_id string, circular_no string, circular_date date, intermediary string, intermediary_label string, supersedes_date date, issued_on date")
RAW_OBLIGATIONS = (
    "clause_id string, seq int, action_required string, obligation_type string, applies_to array<string>, trigger_class string, criticality string, "
    "evidence_artifact string, evidence_class string, deadline_phrase string, parameters string, consequence string, rationale string, source_sentence string, confidence double"
)
USAGE_LOG = ("seq int, job string, model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, seconds double")
AUDIT_RESULT = (
    "mode string, journey string, verdict struct<screens_reviewed:int,violations:int,risks:int,compliant:int,unverifiable:int,ship_recommendation:string,compliance_score:int,top_fixes:array<string>>, "
    "screens array<struct<name:string,findings:array<struct<level:string,severity:string,finding:string,rule:string,fix:string,cx_upside:string>>>>, "
    "banned_patterns array<struct<id:int,pattern:string,result:string,note:string>>, fix_backlog array<struct<priority:int,severity:string,screen:string,change:string,owner:string>>, "
    "unverifiable array<struct<what:string,how_to_settle:string>>, summary string, design_spec_markdown string"
)

# Closed vocabularies.
OBLIGATION_TYPES = ("registration", "conduct", "disclosure", "reporting", "risk_management", "investor_protection", "grievance", "technology", "audit", "governance")
APPLIES_TO = ("stock_broker", "trading_member", "clearing_member", "qualified_stock_broker", "depository_participant", "stock_exchange", "clearing_corporation", "authorised_person", "merchant_banker", "investor")
TRIGGER_CLASSES = ("periodic", "event_driven", "one_time", "conditional")
CRITICALITY = ("binding", "advisory")
EVIDENCE_CLASSES = ("report_filed", "statement_to_client", "disclosure_published", "register_maintained", "audit_report", "system_control", "policy_document", "board_approval", "none")
ENTAILMENTS = ("entailed", "neutral", "contradicted")
DEADLINE_UNITS = ("working_day", "day", "month", "quarter")
SEVERITIES = ("red", "yellow", "green", "white")
LEVELS = ("Flow", "Screen", "Component")
PATTERN_RESULTS = ("pass", "fail", "na")
BANNED_PATTERNS = 15
