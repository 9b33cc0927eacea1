"""Made-up fakes as rows and text: five document types by thirteen kinds of tampering, the same for the same id and seed."""

from __future__ import annotations

# Document types with their fields (a text, or text before a number, its limits, text after it), kinds of
# tampering with what should notice them, and the marks that say what such documents are.
FIELDS = {
    "credit_report": (("Name", "ZHANG TEST"), ("ID No.", "110000", 19700101, 20050101, "0000"), ("Loan Balance", "", 10000, 900000, ".00"), ("Overdue Count", "", 0, 8, ""), ("Query Date", "2026-01-", 10, 28, "")),
    "contract": (("Party A", "Shanghai Demo Company Ltd."), ("Party B", "Training Sample Co., Ltd."), ("Contract Amount", "", 50000, 900000, ".00"), ("Effective Date", "2026-02-", 10, 28, ""), ("Contract No.", "HT-SYN-", 100000, 999999, "")),
    "invoice": (("Buyer", "Training Buyer Co., Ltd."), ("Tax ID", "91310000", 10000000, 99999999, ""), ("Amount", "", 1000, 80000, ".00"), ("Tax", "", 80, 9000, ".00"), ("Invoice No.", "INV-SYN-", 100000, 999999, "")),
    "bank_page": (("Account Name", "Training Account"), ("Account No.", "6222 **** **** ", 1000, 9999, ""), ("Balance", "", 10000, 500000, ".00"), ("Transaction Amount", "", 100, 90000, ".00"), ("Transaction Date", "2026-03-", 10, 28, "")),
    "settlement_statement": (("Payer", "Synthetic Payer Ltd."), ("Payee", "Synthetic Payee Ltd."), ("Settlement Amount", "", 10000, 700000, ".00"), ("Bank Ref", "BNK-SYN-", 100000, 999999, ""), ("Settlement Date", "2026-04-", 10, 28, "")),
}
TAMPERING = {
    "amount_rewrite": "font_text_or_business_logic",
    "date_rewrite": "font_text_or_business_logic",
    "identity_rewrite": "font_text_or_business_logic",
    "stamp_paste": "seal_overlay",
    "signature_paste": "seal_or_signature_overlay",
    "qr_replace": "visual_overlay_or_business_logic",
    "screenshot_to_pdf": "image_ps_or_pdf_object",
    "local_cover_overlay": "pdf_object_or_text_layer",
    "font_mismatch": "font_text_layer",
    "page_splice": "pdf_object_or_layout_consistency",
    "logic_conflict": "business_logic",
    "noise_patch": "image_ps_noise_consistency",
    "text_layer_mismatch": "text_layer_ocr_mismatch",
}
WATERMARK = "SYNTHETIC FAKE - TRAINING ONLY - VOID"
#: What kinds of tampering write into the text layer: text before a number, its limits, how often.
EDITS = {"amount_rewrite": ("EDITED-", 10000, 99999, 2), "date_rewrite": ("EDITED-", 10000, 99999, 2), "identity_rewrite": ("EDITED-", 10000, 99999, 2), "local_cover_overlay": ("EDITED-", 10000, 99999, 4), "font_mismatch": ("FONT-", 10000, 99999, 1), "text_layer_mismatch": ("HIDDEN_ORIGINAL_VALUE_", 100000, 999999, 1), "page_splice": ("INSERTED PAGE VALUE ", 10000, 99999, 1)}
CONFLICT = ("Amount: 10000.00", "Tax: 1300.00", "Total: 19800.00")


def drawn(place: int, low: int, high: int, seed: int) -> str:
    """A number of an id, by its place in the document: a congruence that every engine computes alike."""
    return f"CAST({low} + ((id * {48271 + 2 * place} + {seed * 7919 + place * 104729}) * 69621 + 12345) % {high - low} AS STRING)"


def negatives_sql(ids: str, seed: int = 7) -> str:
    """SQL that makes one fake for each row of a query of ids: document_id, label, doc_type, tamper_type, category, path, text."""
    types, kinds = [*FIELDS], [*TAMPERING]

    def case(key: str, names: list[str], value) -> str:
        return f"CASE {key} " + " ".join(f"WHEN '{name}' THEN {value(name)}" for name in names) + " ELSE '' END"

    def line(k: int, field: tuple) -> str:
        label, before, *rest = field
        return f"concat('{label}: {before}', {drawn(k, rest[0], rest[1], seed)}, '{rest[2]}')" if rest else f"'{label}: {before}'"

    def body(name: str) -> str:
        return "concat_ws(chr(10), " + ", ".join(line(k, f) for k, f in enumerate(FIELDS[name])) + ")"

    def edit(name: str) -> str:
        if name == "logic_conflict":
            return "concat_ws(chr(10), " + ", ".join(f"'{x}'" for x in CONFLICT) + ")"
        before, low, high, times = EDITS[name]
        return "concat_ws(chr(10), " + ", ".join(f"concat('{before}', {drawn(20 + k, low, high, seed)})" for k in range(times)) + ")"

    pick = lambda names, by: f"CASE {by} " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(names)) + " END"
    base = f"SELECT id, {pick(types, f'id % {len(types)}')} AS doc_type, {pick(kinds, f'id % {len(kinds)}')} AS tamper_type FROM ({ids}) i"
    head = f"concat(upper(replace(doc_type, '_', ' ')), ' ', CAST(id AS STRING), chr(10), CASE WHEN tamper_type = 'screenshot_to_pdf' THEN '' ELSE concat({case('doc_type', types, body)}, chr(10), 'Tamper simulation: ', tamper_type, chr(10)) END"
    more = f"CASE WHEN tamper_type = 'page_splice' THEN concat('{WATERMARK}', chr(12)) ELSE '' END, {case('tamper_type', [*EDITS, 'logic_conflict'], edit)}, chr(10), '{WATERMARK}')"
    return f"SELECT printf('synthetic_%06d', id) AS document_id, 'fake' AS label, doc_type, tamper_type, {case('tamper_type', kinds, lambda name: repr(TAMPERING[name]))} AS category, concat('/data/made/synthetic_fake_', CAST(id AS STRING), '_', tamper_type, '.pdf') AS path, {head}, {more} AS text FROM ({base}) b"
