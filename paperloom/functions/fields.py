"""Pattern-based extraction of document fields as Column expressions.

Flags used in the patterns: ``d`` lets ``.``, ``^`` and ``$`` stop at ``\\n`` only, ``U`` makes ``\\s`` and ``\\d``
Unicode-aware, ``s`` lets ``.`` cross lines, ``m`` anchors at every line, ``i`` ignores case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.constants import DOCUMENT_NUMBER, ISSUE_LABELS
from paperloom.functions.text import blank_to_null, let, squeeze, strip, words

# Fixed patterns.
TITLE_PATTERNS = [r"Title[:\s]+(.+)", r"Document Title[:\s]+(.+)", r"Drawing Title[:\s]+(.+)"]
REVISION = r"(?:Rev(?:ision)?\.?\s*)([A-Z0-9]+)"
REVISION_STRICT = r"\bRev(?:ision)?\b\.?\s*([A-Z0-9]+)\b"
CONTRACT = r"(?:Contract|CTR|Agreement)[\s#:]+([A-Z0-9\-]+)"
CONTRACT_STRICT = r"\b(?:Contract|CTR|Agreement)\b[\s#:]+(?:No\.?[\s#:]+)?([A-Z0-9\-]+)"
PAGE_COUNT = r"(?:Page|Sheet)\s+(?:of|/)\s*(\d+)"
# A number is only tried from its first digit, here and below: a long run of digits would cost quadratic time otherwise.
PAGE_COUNT_OF = r"(?<!\d)(\d++)\s*(?:of|/)\s*(\d+)\s*(?:pages|sheets)"
REVISION_HEADING = r"(?:Revision History|Rev(?:ision)? History|REVISION RECORD)"
REVISION_LINE = r"^\s*([A-Z0-9]+)\s+\d{2}/\d{2}/\d{2,4}"
COMMENT_HEADING = r"(?:Comments|COMMENTS|Comment/Response)"
COMMENT_ITEM = r"(?<!\d)(\d++)[\.\)]\s*(.*?)(?:\n|$)\s*(?:Response[:\s]+)?(.*?)(?=\n\d+[\.\)]|\z)"
LEGEND_HEADING = r"(?:Legend|LEGEND|Symbol.*?Description)"
LEGEND_LINE = r"^([A-Za-z0-9_\-]+)\s*[-–]\s*(.+)$"
EQUIPMENT = (
    r"([A-Z]{2,4}-\d{3})\s*[:]\s*(.+?)(?:,\s*|\n)"
    r"(\d+(?:\.\d+)?\s*(?:V|kV|VAC|VDC))?(?:,\s*|\n)?"
    r"(\d+(?:-)?(?:phase|PH))?(?:,\s*|\n)?"
    r"(\d+(?:\.\d+)?\s*(?:Hz|Hz))?(?:,\s*|\n)?"
    r"(\d+(?:\.\d+)?\s*(?:kW|MW|kVA|MVA))?"
)
INDEX_HEADING = r"(?:Drawing Index|DRAWING INDEX|Sheet Index|SHEET INDEX)"
INDEX_LINE = r"(?<!\d)(\d+(?:\.\d+)?)\s*[-–]\s*(.+?)(?:\n|$)"
SIGNATURE_HEADING = r"(?:Signature|SIGNATURE|Approved by|PREPARED|CHECKED|APPROVED)"
SIGNATURE_ROLES = {"prepared_by": "Prepared By", "checked_by": "Checked By", "approved_by": "Approved By"}
PAGE_MARKER = r"\[Page\s+(\d+)\]"
CITATION = r"([A-Z]{2,4}-[A-Z]-[A-Z]{2}-\d{2}-\d{3})\s*[·•]\s*(?:Sheet|Page)\s*(\d+)"
TICK = r"(?:\[X\]|☑|✓|✔)\s*"


def first_group(text: Column, pattern: str, flags: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, f"(?{flags}){pattern}", group))


def all_groups(text: Column, pattern: str, flags: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(group))


def _section(text: Column, heading: str) -> Column:
    """What follows the first heading, up to a blank line or the end."""
    return F.regexp_extract(text, rf"(?dUsi){heading}(.*?)(?:\n\n|\z)", 1)


def extract_document_number(text: Column) -> Column:
    return first_group(text, DOCUMENT_NUMBER, "dU", 0)


def extract_title(text: Column, window: int | None = None, lines_after: int | None = None) -> Column:
    """A named title, or else the first suitable line after the document number.

    That line is looked for in all that follows, or in the first ``window`` characters and ``lines_after`` lines of it.
    """

    def long_enough(title: Column) -> Column:
        return F.when(F.length(title) > 5, title)

    named = [let(squeeze(F.regexp_extract(text, f"(?dUi){p}", 1)), long_enough) for p in TITLE_PATTERNS]
    reach = ".*" if window is None else f".{{0,{window}}}"
    found = F.split(F.regexp_extract(text, f"(?dUs){DOCUMENT_NUMBER}({reach})", 1), "\n")
    lines = F.transform(found if lines_after is None else F.slice(found, 1, lines_after), strip)
    suitable = F.filter(lines, lambda line: (F.length(line) > 5) & ~line.rlike(r"^[A-Z0-9\-]+\z"))
    return F.coalesce(*named, F.get(suitable, F.lit(0)))


def extract_revision(text: Column, strict: bool = False) -> Column:
    return F.upper(first_group(text, REVISION_STRICT if strict else REVISION, "dUi"))


def extract_issue_status(text: Column) -> Column:
    def decide(upper: Column) -> Column:
        ticked = [F.when(upper.rlike(f"(?dU){TICK}{label.upper()}"), code) for label, code in ISSUE_LABELS]
        named = [F.when(upper.contains(label.upper()), code) for label, code in ISSUE_LABELS]
        return F.coalesce(*ticked, *named)

    return let(F.upper(text), decide)


def extract_contract_number(text: Column, strict: bool = False) -> Column:
    return first_group(text, CONTRACT_STRICT if strict else CONTRACT, "dUi")


def extract_page_count(text: Column, given: Column | None = None) -> Column:
    found = [
        first_group(text, PAGE_COUNT, "dUi").try_cast("int"),
        first_group(text, PAGE_COUNT_OF, "dUi", 2).try_cast("int"),
    ]
    if given is not None:
        found.insert(0, F.nullif(given.cast("int"), F.lit(0)))
    return F.coalesce(*found)


def extract_revision_history(text: Column) -> Column:
    lines = F.filter(
        F.split(_section(text, REVISION_HEADING), "\n"),
        lambda line: line.rlike(f"(?dU){REVISION_LINE}"),
    )

    def entry(line: Column) -> Column:
        return let(
            words(line),
            lambda parts: F.struct(
                F.regexp_extract(line, f"(?dU){REVISION_LINE}", 1).alias("rev"),
                F.get(parts, F.lit(1)).alias("date"),
                F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.size(parts)), " ")).alias("description"),
                strip(line).alias("raw"),
            ),
        )

    return F.transform(lines, entry)


def extract_comments(text: Column) -> Column:
    def items(section: Column) -> Column:
        zipped = F.arrays_zip(
            all_groups(section, COMMENT_ITEM, "dUs", 1).alias("n"),
            all_groups(section, COMMENT_ITEM, "dUs", 2).alias("c"),
            all_groups(section, COMMENT_ITEM, "dUs", 3).alias("r"),
        )
        rows = F.transform(
            zipped,
            lambda z: F.struct(
                z["n"].try_cast("int").alias("seq"),
                strip(z["c"]).alias("client_comment"),
                F.when(z["r"] != "", strip(z["r"])).alias("contractor_response"),
            ),
        )
        return F.filter(rows, lambda row: row["client_comment"] != "")

    return let(_section(text, COMMENT_HEADING), items)


def _legend_section(text: Column) -> Column:
    """The wide heading is only tried where it can match: each "Symbol" of a text without "Description" would scan it all."""
    lower = F.lower(text)
    after = F.instr(lower, "symbol") + F.length(F.lit("symbol"))
    both = F.contains(lower, F.lit("symbol")) & (F.position(F.lit("description"), lower, after) > 0)
    return F.when(both, _section(text, LEGEND_HEADING)).otherwise(_section(text, "Legend"))


def extract_legend_symbols(text: Column) -> Column:
    def items(section: Column) -> Column:
        zipped = F.arrays_zip(
            all_groups(section, LEGEND_LINE, "dUm", 1).alias("s"),
            all_groups(section, LEGEND_LINE, "dUm", 2).alias("d"),
        )
        rows = F.transform(
            zipped, lambda z: F.struct(z["s"].alias("symbol"), strip(z["d"]).alias("description"))
        )
        return F.filter(rows, lambda r: (F.length(r["symbol"]) > 1) & (r["description"] != ""))

    return let(_legend_section(text), items)


def extract_equipment_ratings(text: Column) -> Column:
    """One pass over the text for the whole matches; the groups are then read from each short match."""

    def entry(match: Column) -> Column:
        def group(i: int) -> Column:
            return first_group(match, EQUIPMENT, "dUi", i)

        return F.struct(
            group(1).alias("tag"),
            strip(group(2)).alias("rating"),
            group(3).alias("voltage"),
            group(4).alias("phase"),
            group(5).alias("frequency"),
            group(6).alias("power"),
        )

    return F.transform(all_groups(text, EQUIPMENT, "dUi", 0), entry)


def extract_drawing_index(text: Column) -> Column:
    def items(section: Column) -> Column:
        zipped = F.arrays_zip(
            all_groups(section, INDEX_LINE, "dU", 1).alias("n"),
            all_groups(section, INDEX_LINE, "dU", 2).alias("t"),
        )
        rows = F.transform(
            zipped, lambda z: F.struct(z["n"].alias("sheet_no"), strip(z["t"]).alias("sheet_title"))
        )
        return F.filter(rows, lambda r: r["sheet_title"] != "")

    return let(_section(text, INDEX_HEADING), items)


def extract_signature_block(text: Column, strict: bool = False) -> Column:
    """Names by role. The text before and including the first heading is not searched unless ``strict``."""

    def names(section: Column) -> Column:
        # A role that is found with a blank name counts as found, hence the test before the value.
        fields = []
        for field, label in SIGNATURE_ROLES.items():
            pattern = rf"{label}[:\s]+(.+?)(?:\n|$)"
            fields.append(strip(first_group(section, pattern, "dUi")).alias(field))
        return F.struct(*fields)

    return names(text) if strict else let(_section(text, SIGNATURE_HEADING), names)


def extract_page_numbers(text: Column) -> Column:
    return F.transform(all_groups(text, PAGE_MARKER, "dUi", 1), lambda n: n.try_cast("int"))


def starts_page(text: Column) -> Column:
    """True if the text begins with a page marker."""
    return F.regexp_like(text, F.lit(rf"(?dUi)\A(?:{PAGE_MARKER})"))


SCALAR_FIELDS = ["document_number", "title", "revision", "issue_status", "contract_number", "page_count"]
LIST_FIELDS = ["revision_history", "comments", "legend_symbols", "equipment_ratings", "drawing_index"]


def count_extracted_fields() -> Column:
    """Number of present scalars, list entries and signature names of a parsed row."""

    def one(present: Column) -> Column:
        return F.coalesce(present.cast("int"), F.lit(0))

    scalars = [
        one(F.col(name) != 0) if name == "page_count" else one(F.col(name) != "") for name in SCALAR_FIELDS
    ]
    lists = [F.coalesce(F.size(F.col(name)), F.lit(0)) for name in LIST_FIELDS]
    names = [one(F.col(f"signature_block.{role}").isNotNull()) for role in SIGNATURE_ROLES]
    total = F.lit(0)
    for part in scalars + lists + names:
        total = total + part
    return total
