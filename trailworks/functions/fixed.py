"""Word lists, patterns, tables and thresholds that results depend on.

Patterns are Java regular expressions. ``(?U)`` makes ``\\w \\d \\b \\s`` Unicode aware.
"""

# --- Fixed values: file extensions recognised in commands -------------------------------
PATH_EXTENSIONS = (
    "xlsx", "xls", "csv", "tsv", "json", "jsonl", "yaml", "yml",
    "py", "sh", "md", "txt", "docx", "doc", "pdf", "html", "xml",
    "png", "jpg", "jpeg", "svg", "sql", "db", "sqlite", "parquet",
    "pkl", "pickle", "h5", "pt", "onnx", "toml", "cfg", "ini", "log",
)
PATH_PATTERN = r"(?iU)[\w\-./]+\.(?:" + "|".join(PATH_EXTENSIONS) + r")(?:\b|[\"'\s])"

# --- Fixed values: ways a command writes a file -----------------------------------------
WRITE_PATTERNS = (
    r"""(?iU)open\(\s*['"]([^'"]+\.[\w]+)['"]\s*,\s*['"][^'"]*[wax+][^'"]*['"]""",
    r"""(?iU)\.(?:save|write_text|write_bytes|to_csv|to_json|to_excel|to_parquet|to_pickle|to_markdown)\(\s*['"]([^'"]+\.[\w]+)['"]""",
    r"""(?iU)Path\(\s*['"]([^'"]+\.[\w]+)['"]\s*\)\.(?:write_text|write_bytes)\(""",
    r"""(?iU)(?:^|[\s;])>>?\s*(['"]?[\w./-]+\.[\w]+['"]?)""",
    r"""(?iU)(?:^|[;&\n])\s*(?:cp|mv)\s+(?:-[^\s]+\s+)*(['"]?[\w./-]+\.[\w]+['"]?)\s+(['"]?[\w./-]+\.[\w]+['"]?)""",
    r"""(?iU)(?:^|[;&\n])\s*touch\s+(['"]?[\w./-]+\.[\w]+['"]?)""",
)

# --- Fixed values: actions that are infrastructure, not capabilities --------------------
INTERNAL_ACTIONS = (
    "read_file", "write_file", "edit_file", "read_json", "write_json",
    "search_text", "run_test", "inspect_state", "inspect_failure",
)

# --- Fixed values: thinking markers -----------------------------------------------------
RETRY_MARKERS = (
    "retry", "try again", "again", "fix", "correct", "adjust", "update",
    "verify", "double-check", "re-run", "rerun", "instead", "revise",
    "alternative", "different approach", "let me try", "should have",
    "failed because", "error was", "the issue is", "need to",
)
FIX_MARKERS = ("fix", "correct", "adjust", "debug")
# The pattern form "use ... instead" is implied by "instead".
ALTERNATIVE_MARKERS = (
    "alternative", "instead", "rather than", "different approach", "another way", "switch to",
)

# --- Fixed values: signs of an error in a tool result -----------------------------------
EXIT_CODE_PATTERN = r"(?iU)(?:exit code|exit status|returncode)[:\s=]*(\d+)"
ERROR_MARKERS = (
    "Traceback (most recent call last)", "Error:", "error:",
    "FAILED", "ModuleNotFoundError", "KeyError", "FileNotFoundError",
    "AttributeError", "TypeError", "ValueError", "ImportError",
    "Permission denied", "command not found", "No such file",
    "SyntaxError", "IndentationError", "NameError", "RuntimeError",
    "AssertionError", "ZeroDivisionError",
)
LOOSE_ERROR_PATTERNS = (
    r"\bfailed\b", r"\bfailure\b", r"not found",
    r"cannot (?:find|open|read|write|parse|import)", r"unable to",
    r"invalid (?:file|path|argument|value|format|syntax|option)",
    r"no (?:module|file|such|attribute)",
    r"unexpected (?:error|exception|token|indent)",
    r"exception (?:raised|occurred|thrown)",
)

# --- Fixed values: error labels, first matching row wins --------------------------------
TRACE_ERROR_LABELS = (
    ("syntax", ("traceback", "syntaxerror", "indentationerror")),
    ("not_found", ("modulenotfounderror", "importerror", "command not found")),
    ("runtime", ("keyerror", "attributeerror", "typeerror", "valueerror")),
    ("assertion", ("assert", "fail")),
    ("permission", ("permission denied", "access denied")),
    ("missing_file", ("filenotfounderror", "no such file")),
)
TRACE_EXIT_PATTERN = r"(?iU)exit code[:\s]*(\d+)"
OBSTACLE_WORDS = (
    "schema", "layout", "merged", "encoding", "file format",
    "binary file", "cannot read binary", "text-only", "unsupported format",
)
TRANSIENT_STATUS_PATTERN = r"(?U)\b50[234]\b"
INCIDENTAL_ERRORS = ("syntax", "transient", "runtime", "unknown")
TRIVIAL_COMMANDS = ("ls", "pwd", "cd", "echo", "cat", "head", "tail", "mkdir")

# --- Fixed values: cost of one action ---------------------------------------------------
ACTION_COST = {
    "search_text": 0.8, "read_file": 0.6, "edit_file": 1.2, "write_file": 1.1,
    "run_test": 1.4, "inspect_failure": 0.9, "inspect_state": 0.5,
    "read_spreadsheet": 0.9, "write_spreadsheet": 1.2, "extract_pdf": 1.0,
    "read_json": 0.6, "write_json": 0.9, "read_dataframe": 0.8,
    "write_dataframe": 1.0, "generate_plot": 1.1, "http_request": 0.7,
    "parse_html": 0.9,
}
DEFAULT_ACTION_COST = 0.4
FAILURE_SURCHARGE = 0.8

# --- Fixed values: redaction ------------------------------------------------------------
SECRET_PATTERN = r"(?iU)(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+"
ABSOLUTE_PATH_PATTERN = r"(?U)(?<!\w)/(?:[^\s`'\"]+/)+[^\s`'\"]+"
EXPECTED_VALUE_PATTERN = (
    r"(?iU)(?:expected|want|should be|must equal)\s+[^\n]{1,240}"
    r"(?:\s+(?:got|actual|received)\s+[^\n]{1,240})?"
)
REDACTED_CREDENTIAL = "[redacted credential]"
REDACTED_PATH = "[redacted path]"
REDACTED_EXPECTED = "[redacted expected-value comparison]"

# --- Fixed values: reflection headings and fallbacks ------------------------------------
REFLECTION_HEADINGS = (
    "FAILURE OBSERVABLE", "CAUSAL STEP(S)", "CAUSAL EVIDENCE", "DIAGNOSIS CONFIDENCE",
    "ROOT CAUSE", "CORRECTIVE ACTION", "MISSING",
)
DEFAULT_OBSERVATION = "A prior training attempt failed verification."
DEFAULT_LESSON = "Validate the causal step and repair it before retrying."
DEFAULT_RATIONALE = "The reflection did not establish a root cause."
DEFAULT_INTENT = "recover from a verifier-reported task failure"
DEFAULT_OBSTACLE = "reflection did not establish a root cause"
DEFAULT_RESOLUTION = "Validate the stated causal step and repair it before retrying."
RESIDUAL_LESSON = (
    "The recurring procedure from this episode was compiled into the family skill. "
    "Use this memory only for its instance context, observation, rationale, and outcome."
)

# --- Fixed values: stop words per tokenizer ---------------------------------------------
RETRIEVAL_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is",
    "it", "of", "on", "or", "that", "the", "this", "to", "with",
)
AUDIT_STOP_WORDS = (
    "when", "use", "this", "task", "with", "from", "that", "into", "must", "should",
    "before", "after", "only", "required", "output", "input",
)
AUDIT_COMMON_COMMAND_WORDS = (
    "python", "python3", "import", "print", "open", "path", "artifact", "num",
)
COMPACTION_STOP_WORDS = (
    "and", "are", "before", "current", "each", "every", "from", "into",
    "must", "only", "required", "the", "this", "when", "with", "your",
    "then", "that", "after", "task", "output", "artifact", "source",
)
SECTION_STOP_WORDS = (
    "and", "are", "artifact", "before", "check", "current", "from", "into", "must", "not",
    "or", "output", "skill", "task", "that", "the", "this", "when", "with",
)

# --- Fixed values: instruction kinds ----------------------------------------------------
VALIDATION_TERMS = (
    "validat", "verif", "reopen", "integrity", "completion", "final scan",
    "acceptance", "well-formed", "parse successfully",
)
PLANNING_TERMS = (
    "plan", "planning", "derive", "contract", "inventory", "manifest",
    "before editing", "before mutation", "before writing", "identify",
)
CHECKING_TERMS = (
    "check", "confirm", "compare", "ensure", "inspect", "count", "preserve",
    "review", "assert",
)

# --- Fixed values: contract extraction --------------------------------------------------
CAPABILITY_TERMS = (
    ("terminal-operation", ("terminal", "shell", "command", "cli", "server")),
    ("artifact-generation", ("write", "save", "export", "output", "generate", "create")),
    ("input-parsing", ("read", "load", "parse", "extract")),
    ("debugging", ("fix", "debug", "error", "failing", "broken")),
    ("validation", ("test", "verify", "validate", "check")),
)
CONSTRAINT_TERMS = ("must", "exactly", "do not", "only", "required")

# --- Fixed values: usage traces in a step log -------------------------------------------
SKILL_USE_PATTERN = r"(?i)/(?:\.claude|\.codex|\.agents)/skills/([a-z0-9][a-z0-9-]*)/SKILL\.md"
POLICY_USE_PATTERN = r"(?i)references/(?:policies/)?([a-z0-9][a-z0-9-]+)\.md"
IMPLEMENTATION_USE_PATTERN = r"(?i)(?:implementation|impl):([a-z0-9-]+)"
SCRIPT_USE_PATTERN = r"(?i)scripts/(?:experimental|capabilities)/([a-z0-9_.-]+\.py)"
MEMORY_USE_PATTERN = r"(?i)(memory-[a-f0-9]{20})"
MEMORY_QUERY_PATTERN = r"(?i)(mcp__experience_memory__(?:search_memories|get_memory))"

# --- Fixed values: log clean-up and evidence sampling -----------------------------------
ANSI_PATTERN = r"\x1b\[[0-?]*[ -/]*[@-~]"
CAST_EVENT_PATTERN = r"^\[\s*\d+(?:\.\d+)?\s*,\s*\"[io]\"\s*,"
PROGRESS_PATTERN = r"^(?:[#=\-\s]{20,}(?:\s*\d+(?:\.\d+)?%)?|[⠁⠂⠄⡀⢀⠠⠐⠈⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏])$"
LOG_CHUNK_LINES = 25
EVIDENCE_STEPS = 120
EVIDENCE_HEAD = 8
EVIDENCE_TAIL = 24
CRITICAL_ACTIONS = (
    "bash", "shell", "command", "write", "edit", "create", "patch",
    "delete", "move", "copy", "test", "pytest", "tool_result_error",
)
CRITICAL_TEXT = ("traceback", "error", "failed", "exception", "assertionerror")
MAX_FEEDBACK = 25
MAX_CAUSAL_STEPS = 10
CAUSAL_ACTIONS = ("write", "edit", "create", "save", "bash", "tool_result_error")

# --- Fixed values: retrieval weights and gates ------------------------------------------
SEMANTIC_WEIGHT = 0.75
LEXICAL_WEIGHT = 0.25
MIN_SEMANTIC = 0.38
MIN_HYBRID = 0.34
MIN_COVERAGE = 0.5
MIN_LEXICAL = 0.2
BM25_K1 = 1.2
BM25_B = 0.75

# --- Fixed values: action families of shell commands, first match wins --------------------
COMMAND_START = r"(?U)(^|[;&|]\s*)"
READ_COMMANDS = ("cat", "less", "more", "head", "tail", "nl")
PATCH_COMMAND = "apply_patch"
FAILURE_WORDS = ("traceback", "failed", "error", "assert")
SPREADSHEET_PATTERN = r"(?U)\b(openpyxl|xlrd|xlwt|xlwings|xlsxwriter)\b"
ACTION_PATTERNS = (
    ("search_text", COMMAND_START + r"(rg|grep|find)\b"),
    ("read_file", COMMAND_START + r"sed\s+-n\b"),
    ("write_spreadsheet", SPREADSHEET_PATTERN),
    ("read_spreadsheet", SPREADSHEET_PATTERN),
    ("extract_pdf", r"(?U)\b(pdfplumber|pypdf|pdfminer|fitz\b|pikepdf|camelot)\b"),
    ("write_json", r"(?U)\bjson\.(dump|dumps)\b"),
    ("read_json", r"(?U)\bjson\.(load|loads)\b"),
    ("read_dataframe", r"(?U)\bpd\.read_\w+\b"),
    ("write_dataframe", r"(?U)\bpd\.to_\w+\b|\.to_csv\(|\.to_excel\(|\.to_json\(|\.to_parquet\("),
    ("edit_file", r"(?sU)(^|[;&|]\s*)(python|python3)\b.*\b(write_text|write_bytes|open\()"),
    ("write_file", None),
    ("run_test", COMMAND_START + r"(pytest|python\s+-m\s+pytest|npm\s+test|pnpm\s+test|yarn\s+test|cargo\s+test|go\s+test)\b"),
    ("inspect_state", COMMAND_START + r"(git\s+diff|git\s+status|git\s+show)\b"),
    ("inspect_failure", None),
    ("generate_plot", r"(?U)\b(plt\.\w+|sns\.\w+|\.plot\(|\.scatter\(|\.bar\(|\.hist\()"),
    ("http_request", r"(?U)\b(requests\.\w+|urllib\.request|httpx\.\w+|curl\b)"),
    ("parse_html", r"(?U)\b(bs4|\.select\(|\.find_all\(|lxml|html\.parser)"),
)

# --- Fixed values: what stands for task-specific parts of a command ------------------------
COMMAND_SHAPE_PATTERNS = (
    (r"(?i)(['\"])[^'\"]+\.(?:xlsx?|csv|tsv|jsonl?|pdf|docx?|py|txt|ya?ml|xml)\1", "<artifact>"),
    (r"(?U)(?:^|[\s=(])(/[^\s'\")]+)", " <path>"),
    (r"(?U)\b[A-Z]{2,}[A-Z0-9_-]*\d{3,}\b", "<id>"),
    (r"(?U)\b\d+(?:\.\d+)?\b", "<num>"),
)
ATTEMPT_SHAPE_PATTERNS = (
    (r"(?U)[/\\][\w./\\-]+", "<path>"),
    (r"(?U)\b\d+(?:\.\d+)?\b", "<num>"),
)

# --- Fixed values: what stands for instance literals in texts ------------------------------
PARAMETER_PATTERNS = (
    (r"(?U)[/\\][\w./\\-]+", "<path>"),
    (r"(?iU)(?<![\w$])\$?[a-z]{1,3}\$?\d+(?!\w)", "<cell>"),
    (r"(?U)\b\d+(?:\.\d+)?\b", "<num>"),
)
CLUSTER_PATTERNS = (
    (r"(?U)[/\\][\w./\\-]+", "<path>"),
    (r"(?U)\b[\w.-]+\.(xlsx|xls|csv|json|pdf|png|jpg|xml|ya?ml|py|txt)\b", "<$1>"),
)
EVIDENCE_PATTERNS = (
    (r"(?U)(?:[A-Za-z]:)?(?:/|\\)(?:[^\s/\\]+(?:/|\\))+[^\s]*", "<path>"),
    (r"(?U)\b\d{4,}(?:\.\d+)?\b", "<value>"),
    (r"(?U)\b[A-Fa-f0-9]{24,}\b", "<token>"),
)
COMPACTION_PATTERNS = (
    (r"[`*_~]", " "),
    (r"(?U)\b\d+(?:\.\d+)?\b", "<n>"),
)

# --- Fixed values: names, paths and tokens in texts ----------------------------------------
TEST_NAME_PATTERN = r"(?mU)^def\s+(test_[a-zA-Z0-9_]+)\s*\("
OUTPUT_PATH_PATTERN = r"(?U)(?<![\w.-])(/[^\s`'\"<>]+(?:\.[A-Za-z0-9_-]+)?)"
RETRIEVAL_TOKEN = r"[a-z0-9_]+|[\u3400-\u9fff]"
AUDIT_TOKEN = r"[a-z][a-z0-9-]{2,}"
POLICY_TOKEN = r"[a-z][a-z0-9_-]{2,}"
SECTION_TOKEN = r"(?i)[a-z0-9][a-z0-9_-]{2,}"

# --- Fixed values: list items that may be compacted --------------------------------------
LIST_ITEM = r"^(\s*(?:[-*+]\s+|\d+[.)]\s+|[-*+]\s+\[[ xX]\]\s+))(.*\S)\s*$"
COMPACTION_MIN_CHARS = 24

# --- Fixed values: other thresholds -----------------------------------------------------
CLUSTER_SIMILARITY = 0.75
NEAR_DUPLICATE_OVERLAP = 0.72
AUDIT_MIN_SHARED = 3
AUDIT_MIN_OVERLAP = 0.30
MIN_OCCURRENCES = 3
MIN_QUALITY_CONFIDENCE = 0.7
DEGRADATION_THRESHOLD = 0.20
AUDIT_LABELS = ("spontaneous", "exploration-induced", "task-specific", "ambiguous")
CLUSTER_ALGORITHM = "semantic-v2-kind-partitioned"
CANDIDATE_KINDS = ("recovery_candidate", "atomic_substep", "workflow")
EVIDENCE_LABELS = ("verified_success", "unresolved_failure", "tool_recovery")
