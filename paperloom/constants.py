"""Fixed values of the document-control domain. Results depend on them, so they are stated as they are."""

DISCIPLINES = ["ELC", "MEC", "INS", "SIM"]

CHECKING, APPROVED, REJECTED = "Checking", "Approved", "Rejected"
DOCUMENT_STATUSES = [CHECKING, APPROVED, REJECTED]
FINAL_STATUSES = [APPROVED, REJECTED]

BLOCKING, WARNING = "blocking", "warning"
PARENT, CHILD = "parent", "child"

# extension -> (extractor, MIME type)
FILE_TYPES = {
    ".docx": ("office", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".dwg": ("cad", "image/vnd.dwg"),
    ".dxf": ("cad", "image/vnd.dxf"),
    ".jpeg": ("image", "image/jpeg"),
    ".jpg": ("image", "image/jpeg"),
    ".pdf": ("pdf", "application/pdf"),
    ".png": ("image", "image/png"),
    ".pptx": ("office", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".tif": ("image", "image/tiff"),
    ".tiff": ("image", "image/tiff"),
    ".xlsx": ("office", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
}

DOCUMENT_NUMBER = r"[A-Z]{2,4}-[A-Z]-[A-Z]{2}-\d{2}-\d{3}"

# label looked for -> issue status, in order of precedence
ISSUE_LABELS = [
    ("IFR", "IFR"),
    ("Issued for Review", "IFR"),
    ("IFA", "IFA"),
    ("Issued for Approval", "IFA"),
    ("IFC", "IFC"),
    ("Issued for Construction", "IFC"),
    ("ASB", "ASB"),
    ("As Built", "ASB"),
    ("IFI", "IFI"),
    ("Issued for Information", "IFI"),
]

OCR_CONFIDENCE = 0.75
OCR_TOKEN_FLOOR = 0.1
NATIVE_TEXT_CHARS_PER_PAGE = 50
DRAWING_MIN_TEXT_PARTS = 10

PARENT_SIZE, PARENT_OVERLAP = 1024, 128
CHILD_SIZE, CHILD_OVERLAP = 256, 32
TOKENS_PER_WORD = 1.3

EMBEDDING_DIM = 384
VECTOR_LISTS = 100
VECTOR_WEIGHT, TEXT_WEIGHT = 0.6, 0.4
SEARCH_LIMIT, ASK_LIMIT, CITATION_LIMIT = 10, 5, 5

NO_CONTEXT_ANSWER = "I cannot find this information in the provided documents."

# declared maximum lengths of the document table; True marks a column that must not be null
DOCUMENT_LIMITS = {
    "document_number": (50, False),
    "title": (500, False),
    "revision": (20, False),
    "issue_status": (10, False),
    "contract_number": (100, False),
    "discipline": (10, False),
    "file_hash": (64, True),
    "status": (20, True),
    "job_id": (100, False),
}
CHUNK_LIMITS = {
    "document_id": (None, True),
    "level": (10, True),
    "content": (10000, True),
    "token_count": (None, True),
}

# The 127 English stop words of the Snowball list, as used by common full-text configurations.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()
