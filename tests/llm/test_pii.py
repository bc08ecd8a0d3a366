import pytest

from estateloom.llm import pii as P

LEX = P.Lexicon([("Hedda", "given"), ("Tobin", "given"), ("Rose", "given"), ("Ostrowen", "surname"), ("Winter", "surname"), ("Steele", "surname"), ("O'Brannoch", "surname")])


def found(text):
    return {(k, text[a:b]) for a, b, k in P.find(text, LEX)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail noc@north.example, ssh deploy@edge-1 works, express@4.18.2 pinned", {("email", "noc@north.example")}),
        ("to a.b[at]mail[dot]co[dot]example; c (at) d.example", {("email", "a.b[at]mail[dot]co[dot]example"), ("email", "c (at) d.example")}),
        ("we met at noon and dot the line", set()),
        ("call +44 (0)7700 900 325 or 212 555 0163 ext. 655", {("phone", "+44 (0)7700 900 325"), ("phone", "212 555 0163 ext. 655")}),
        ("tel. ０７７００　９００４００", {("phone", "０７７００　９００４００")}),
        ("PO 450003001, 10.25.5.77, licence ref 900-12-2512-AX, product key 4411-3710-1182-0921, ports 8443-8450, 2027-01-14", set()),
        ("passport no. C03577864 on the form; NI number QQ 58 68 44 C; DNI: 40.281.736-Y; SSN 935-02-6742", {("id_number", "C03577864"), ("id_number", "QQ 58 68 44 C"), ("id_number", "40.281.736-Y"), ("id_number", "935-02-6742")}),
        ("pay with 4111 1111 1111 1111 or DE89 3704 0044 0532 0130 00", {("id_number", "4111 1111 1111 1111"), ("id_number", "DE89 3704 0044 0532 0130 00")}),
        ("Harbour Lane DC, hall 2; ship to 12b Old Mill Road, Bramholt XX5 8BE", {("address", "12b Old Mill Road, Bramholt XX5 8BE")}),
        ("Standort Lerchenstraße 237, 07044 Weißkirch", {("address", "Lerchenstraße 237, 07044 Weißkirch")}),
        ("103 rue des Tilleuls, 88711 Saint-Orvin", {("address", "103 rue des Tilleuls, 88711 Saint-Orvin")}),
        ("per Mrs. Hedda von Ostrowen: done; ask O'BRANNOCH, Tobin, Betrieb durch Team Nord", {("name", "Hedda von Ostrowen"), ("name", "O'BRANNOCH, Tobin")}),
        ("Rose Hill failover pair, Steele cluster node 4, winter freeze applies", set()),
        ("负责人 岑若澜; J. Winter confirmed in the workshop", {("name", "岑若澜"), ("name", "J. Winter")}),
        ("", set()),
    ],
)
def test_spans(text, want):
    assert found(text) == want


def test_validators():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("DE89370400440532013000") and not P.mod97("DE89370400440532013001")
    assert P.dni_letter("12345678Z") and not P.dni_letter("12345678A")


def test_redaction_keeps_the_rest(spark):
    texts = spark.createDataFrame([("t", "1", "call +1 212 555 0155 now"), ("t", "2", None), ("t", "3", "")], "source_table string, row_key string, text string")
    lex = spark.createDataFrame([("Hedda", "given")], "token string, kind string")
    got = {r.row_key: (r.redacted, len(r.found)) for r in P.scanned(texts, lex).collect()}
    assert got == {"1": ("call [PHONE] now", 1), "2": (None, 0), "3": ("", 0)}
    assert P.scanned(texts.limit(0), lex.limit(0)).count() == 0


def test_every_form_of_address_passes_the_gate():
    german = ["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "graben", "hof", "steig", "chaussee"]
    texts = [f"12 Old Mill {w}" for x in P._EN_TYPES[3:-1].split("|") for w in (x, x.upper())]
    texts += [f"Lerchen{x} 5" for x in german]
    texts += [f"{w} Mayor 235, 36807 Villasur" for x in P._ES_TYPES[3:-1].split("|") for w in {x.replace(r"\.?", "").replace("\\", ""), x.replace(r"\.?", ".").replace("\\", "")}]
    texts += [f"103 {w} des Tilleuls, 88711 Saint-Orvin" for x in P._FR_TYPES[3:-1].split("|") for w in {x.replace(r"\.?", ""), x.replace(r"\.?", ".")}]
    assert [t for t in texts if not any(True for _ in P._addresses(t))] == []
    assert [t for t in texts if ("address", t) not in found(t)] == []


def test_a_failed_checksum_refutes_account_and_card_numbers():
    from estateloom.llm.pii import Lexicon, find

    kinds = lambda t: [k for _, _, k in find(t, Lexicon([]))]
    assert kinds("credit card 4111 1111 1111 1111") == ["id_number"] and kinds("credit card 4111 1111 1111 1112") == []
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["id_number"] and kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("passport no. Z91739683") == ["id_number"]


def test_notes_come_from_the_grammar():
    from estateloom.llm.pii import notes_of

    head = "hostname,os,vcpu,notes"
    assert notes_of('"web, main",RHEL 8,4,call Anna', head) == "call Anna"
    assert notes_of('web,RHEL,4,"call ""Anna"", please"\r', head) == 'call ""Anna"", please'
    assert notes_of("web,RHEL,4,call, Anna", head) == "call, Anna"  # a field too many
    assert notes_of('web,RHEL,4,19" rack, Anna', head) == '19" rack, Anna' and notes_of('web,"RHEL,4,call Anna', head) == '"RHEL,4,call Anna'
    assert notes_of("web;RHEL;4;call, Anna", "hostname;os;vcpu;notes") == "call, Anna" and notes_of("short", head) == "short" and notes_of("", None) == ""
