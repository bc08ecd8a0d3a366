"""Training-data operators over tables with rows of nulls, repeated rows and clashing columns."""

from estateloom.llm import mixing, packing, pii, secrets, sentences, survivors
from tests.test_nulls import CLAIMS, INVENTORY, table

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
FILES = "file_id bigint, relative_path string, text string"


def test_documents(spark):
    df = table(spark, DOCUMENTS, {"doc_id": 1, "text": "One. Two.", "source": "s"}, {"doc_id": 2, "source": "s"}, {"doc_id": 3, "text": ""})
    assert {(r.doc_id, r.start_pos) for r in sentences.sentence_units(df).collect()} == {(1, 0), (1, 5)}
    assert packing.packed(df, capacity=2).where("n_tokens > 0").count() == 4
    targets = table(spark, "source string, target_share double, max_repeats int", {"source": "s", "target_share": 1.0, "max_repeats": 2})
    assert {r.doc_id for r in mixing.mixed(df, targets).collect()} == {1}
    assert mixing.shares(df, targets).count() == 1


def test_files(spark):
    df = table(spark, FILES, {"file_id": 1, "relative_path": "a", "text": "password=harbour-12345"}, {"file_id": 2})
    assert {(r.file_id, r.line_no) for r in secrets.find_credentials(df).collect()} == {(1, 1)}
    assert secrets.redacted_files(df).count() == 6


def test_claims_and_lines(spark):
    claims = table(spark, CLAIMS, {"assessment_id": "a", "claim_id": "1", "value": "x", "evidence_quote": "mail a@b.example"}, {"assessment_id": "a", "claim_id": "2", "confidence": float("nan"), "value": "y"})
    lines = table(spark, INVENTORY, {"line_id": 1, "file_kind": "messy-inventory", "line_no": 2, "raw_line": "h,o,4,call +1 212 555 0155"}, {"line_id": 2, "file_kind": "messy-inventory", "line_no": 3})
    lexicon = table(spark, "token string, kind string", {"token": "Hedda", "kind": "given"})
    found = {(r.row_key, x.pii_text) for r in pii.scanned(pii.texts_of(claims, lines), lexicon).collect() for x in r.found or []}
    assert found == {("1", "a@b.example"), ("1", "+1 212 555 0155")}
    documents = table(spark, "document_id string, precedence int")
    rows = survivors.survivors(claims, documents).collect()
    assert [(r.value_claim_id, r.quote_claim_id) for r in rows] == [("2", "1")]  # equal in every rank: the higher id
