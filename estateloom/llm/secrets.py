"""Credentials in source code and configuration: literals in assignment contexts, judged by what no dictionary explains.

A literal is segmented into dictionary words by Viterbi (unigram costs from a public word vocabulary); the characters that
no word explains are its residual. A literal is a credential if its context and its residual together say so: the less a
name says, the more must be left over; under a name of a password a literal that words explain wholly is a weak password,
unless it is written as a reference. References, placeholders, empty values, identifiers, certificates and public keys are
excluded, and hash formats where the name does not say that a secret stands there (keys and tokens of 32 or 40 hexadecimal
digits look like hashes and are secrets under such names).

Spark partitions the files; the scan is a helper run over Arrow batches. Files are independent, so no key can be hot; a
file's whole text is scanned in time linear in its length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from estateloom.functions.skew import spread

#: a BPE vocabulary whose ids rise with falling frequency; tokens with the word-end mark are whole words
WORDS_FILE = "/opt/tokenizers/word_bpe_49k.json"

# Last words of names that hold a credential; passwords, then tokens and keys, then words that need a residual.
PASSWORD_HEADS = {"password", "passwd", "pwd", "pass", "passphrase", "pw", "kennwort", "passwort", "contrasena", "contraseña", "motdepasse", "senha"}
TOKEN_HEADS = {"token", "secret", "credential", "credentials", "cred", "apikey", "accesskey", "authtoken", "bearer", "pat", "jwt"}
KEY_HEADS = {"key", "auth", "authorization", "signature", "sig", "cookie", "dsn", "seed", "salt", "pk"}
#: words before "key" that make it a name like "token"
KEY_KINDS = {"api", "access", "secret", "signing", "private", "encryption", "auth", "hook", "master", "account", "shared", "client", "service", "webhook"}

_PLACEHOLDER = re.compile(
    r"""x{3,}|\*{2,}|\.{3,}|-+|_+|\?+|<[^<>]*>?|\[[^\[\]]*\]|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|\{\{.*|@[A-Za-z_.]+@|\#\{.*
    |(?:vault|env|ref|secret|file|ssm|op|awssm|keyvault|arn)[:!].*|(?:your|my|the|some|insert|enter|put|add)[-_ ]?.*(?:password|passwd|key|token|secret|here|value).*|your[-_ ].*
    |(?:replace|change|fill|set)[-_ ]?(?:it|me|this|in|with)?[-_ ]?.{0,4}|(?:re)?dacted|placeholder|example|sample|dummy|todo|tbd|none|null|nil|undefined|empty|true|false|yes|no|unset|default|n/a|hidden|masked|removed
    |(?:process|os|sys|system|env|config|settings|ctx|self|this|import|require|getenv|std)[.\[(]\w*.*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\(.*|Ref|Fn::.*""",
    re.X | re.I,
)
_HASH = re.compile(r"(?:sha\d*[-:])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+", re.I)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
#: a run of word characters of any length (possessive, and never started inside one), then a bounded rest with dots and
#: hyphens, behind each of which a match may start anew: a line of any length is scanned in linear time and no name is cut
_NAME = r"[A-Za-zÀ-ÿ_$][\wÀ-ÿ$]*+(?:[.-][\wÀ-ÿ$.-]{0,80})?"
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: name, separator, value: quoted or up to white space and closing marks
_ASSIGN = re.compile(
    rf"""(?<![\w$])(?P<q>["']?)(?P<name>{_NAME})(?P=q)\]?\s*(?:=>|:=|[:=](?!=))\s*(?:(?P<vq>["'`])(?P<quoted>(?:\\.|(?!(?P=vq)).)*)(?P=vq)?|(?P<bare>[^\s"'`,;&<>{{}}()\[\]][^\s"'`,;&<>)\]}}]*))""", re.X
)
_XML = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]*)?>(?P<value>[^<>]*)</(?P=name)>")
_XML_OPEN = re.compile(rf"^\s*<(?P<name>{_NAME})(?:\s[^<>/]*)?>\s*$")
_USERINFO = re.compile(r"(?:(?<![a-z0-9])[a-z][a-z0-9+.-]{0,20}://|(?:^|[/\s\"'=]))(?P<user>[\w.%+-]*):(?P<value>[^\s/@:\"'<>]+)@(?=[\w.-]+)", re.I)
_JDBC_THIN = re.compile(r"jdbc:\w+:\w+:(?P<user>[\w.]+)/(?P<value>[^\s/@\"']+)@")
_FLAG = re.compile(rf"(?<![\w-])--?(?P<name>[A-Za-z][\w-]*+)(?:\s+|=)(?P<q>[\"']?)(?P<value>[^\s\"']+)(?P=q)")
_CURL_USER = re.compile(r"(?:-u|--user)\s+(?P<q>[\"']?)(?P<user>[^\s\"':]+):(?P<value>[^\s\"']+)(?P=q)")
_SCHEME = re.compile(r"\b(?:Bearer|Basic|Token|Digest)\s+(?P<value>[A-Za-z0-9._~+/=-]{8,})")
_LOGIN_CALL = re.compile(r"\b\w*(?:login|log_in|sign_?in|auth(?:enticate)?|connect)\w*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"'](?P<value>[^\"']+)[\"']", re.I)
_LOGIN_SAID = re.compile(r"\b(?:login|user|account|creds?|credentials)\b:?\s+(?P<user>[\w.-]+)\s*/\s*(?P<value>\S+)", re.I)
_SPACED = re.compile(rf"(?<![\w-])(?P<name>{_NAME})\s+(?P<q>[\"']?)(?P<value>[^\s\"']{{8,}})(?P=q)")
_NAMED = re.compile(rf"""(?:["']?name["']?\s*[:=]\s*)["']?(?P<name>{_NAME})["']?\s*,?\s*$""", re.I)
_VALUED = re.compile(r"""["']?value["']?\s*[:=]\s*(?P<q>["']?)(?P<value>[^"']*?)(?P=q)\s*,?\s*$""", re.I)
_FOLDED = re.compile(rf"""(?:^|[\s{{,])["']?(?P<name>{_NAME})["']?\s*[:=]\s*(?:[>|][+-]?\d*|\\|\(|["'`]{{3}})?\s*$""")
_LITERAL_LINE = re.compile(r"""^\s*(?P<q>["'`]?)(?P<value>(?!\w+=[^=])[^\s"'`<>]+)(?P=q)[,;)]?\s*(?:\+|\\)?\s*$""")
_COMMAND = re.compile(r"\b(?:sshpass|mysql\w*|mariadb\w*|mongo\w*|ldap\w+|redis-cli|docker\s+login|helm|psql|smbclient|7z|zip|unzip)\b[^|;]*?\s-(?:p|a|w|P)\s?(?P<q>[\"']?)(?P<value>[^\s\"']+)(?P=q)")
_PAIR = re.compile(rf"""\b(?:key|name)["']?\s*[=:]\s*["'](?P<name>{_NAME})["']\s*,?\s*["']?value["']?\s*[=:]\s*["'](?P<value>[^"']*)["']""", re.I)
#: a line without any of these holds no context of a credential
_HINTS = (
    "pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "kennwort", "contrase", "senha", "bearer", "basic", "digest", "jdbc", "@", "login", "sign", "-----begin", "cookie", "seed", "salt", "dsn", "pk", "pat", "jwt",
    "sig", "user", "account", "connect", " -u", " -p", " -a", " -w",
)
_CONTINUED = re.compile(r"""(?P<end>["'])\s*[+.&\\]\s*$""")
_PIECE = re.compile(r"""\s*["'](?P<rest>[^"']*["'].*)$""")
_PART = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[a-zà-ÿ]+|\d+")


@lru_cache(maxsize=2)
def dictionary(words_file: str) -> dict[str, float]:
    """Cost of each whole word of three letters or more, by its rank (Zipf's law); the vocabulary bounds its size."""
    with open(words_file, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    ranked = sorted((i, w[:-4]) for w, i in ids.items() if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha())
    return {w: math.log(r + 10) + 1.0 for r, (_, w) in enumerate(ranked)}


#: cost of one character that no word explains: uniform over letters of both cases and digits
_CHAR = math.log(62)


_ENDINGS: dict[tuple[int, int], dict[str, int]] = {}


def _endings(words: dict[str, float]) -> dict[str, int]:
    """The longest word by its last three letters, found once per dictionary; most places of a random string end no word."""
    key = (id(words), len(words))
    if (ends := _ENDINGS.get(key)) is None:
        ends = _ENDINGS[key] = {}
        for w in words:
            ends[w[-3:]] = max(len(w), ends.get(w[-3:], 0))
    return ends


def residual(literal: str, words: dict[str, float]) -> int:
    """Letters and digits of ``literal`` that the cheapest segmentation into dictionary words leaves unexplained."""
    left, endings = 0, _endings(words)
    for run in re.findall(r"[^\W_]+", literal):
        low = run.lower()
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(low) + 1):
            cost, bare = best[end - 1]
            choice = (cost + _CHAR, bare + 1)
            for start in range(max(0, end - endings.get(low[max(0, end - 3) : end], 0)), end - 2):
                if (w := words.get(low[start:end])) is not None:
                    # a word whose case changes inside is chance, as in random strings
                    part = run[start:end]
                    if part in (part.lower(), part.upper(), part.capitalize()):
                        choice = min(choice, (best[start][0] + w, best[start][1]))
            best.append(choice)
        left += best[-1][1]
    return left


@lru_cache(maxsize=65536)
def name_weight(name: str) -> int:
    """3: names a password; 2: a token or secret key; 1: something that may hold one; 0: anything else. The last word decides."""
    parts = [p.lower() for p in _PART.findall(name.rpartition(".")[2] or name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return 0
    joined, head = "".join(parts), parts[-1]
    if head in PASSWORD_HEADS or any(joined.endswith(h) for h in ("password", "passwd", "kennwort", "contrasena")):
        return 3
    if head in TOKEN_HEADS or any(joined.endswith(h) for h in TOKEN_HEADS if len(h) > 4):
        return 2
    if head == "key" and len(parts) > 1 and parts[-2] in KEY_KINDS:
        return 2
    return 1 if head in KEY_HEADS else 0


def is_literal(value: str) -> bool:
    return bool(value) and not _PLACEHOLDER.fullmatch(value)


def judge(value: str, weight: int, quoted: bool, words: dict[str, float]) -> bool:
    """Is ``value`` a credential under a name of this weight?"""
    value = value.strip()
    if not is_literal(value) or value.startswith(("data:", "http://", "https://", "/", "./", "-----BEGIN")) or re.search(r"\s", value):
        return False
    if weight < 3 and _UUID.fullmatch(value) or (weight < 2 and _HASH.fullmatch(value)):
        return False
    left, digits, upper = residual(value, words), sum(c.isdigit() for c in value), sum(c.isupper() for c in value)
    if weight == 3:
        # words alone: a weak password, unless it reads as a reference to where the password is
        reference = not left and not quoted and re.fullmatch(_NAME, value) and ("." in value or "_" in value or name_weight(value) > 0)
        return len(value) >= 4 and not reference
    if weight == 2:
        mixed = left and digits and upper and any(c.islower() for c in value) and len(value) >= 8
        return len(value) >= 6 and (left >= 3 or bool(mixed)) and not re.fullmatch(r"[\d.,:%]{1,11}\w?", value)
    if weight == 1:
        return left >= 12 and digits + upper >= 3
    # a name that says nothing: hardly a word in it, and all kinds of characters, as only random strings have
    return bool(_RANDOM.fullmatch(value)) and left >= 24 and digits >= 3 and upper >= 3 and sum(c.islower() for c in value) >= 3


#: quoted literals under any name that may be random strings: one run of 24 characters or more, no path, address or file
_NEUTRAL = re.compile(rf"""(?<![\w$])(?P<q>["']?)(?P<name>{_NAME})(?P=q)\]?\s*(?:=>|:=|[:=](?!=))\s*(?P<vq>["'`])(?P<value>[A-Za-z0-9_+=-]{{24,}})(?P=vq)""")
_RANDOM = re.compile(r"[A-Za-z0-9_+=-]{24,}")
#: names and lines that hold digests, identifiers, certificates or public keys
_PUBLIC = re.compile(r"integrity|checksum|digest|sha|hash|md5|sum|etag|cert|public|pub|finger|uuid|guid|nonce|commit|revision|rev|version|image|blob|data|icon|font|build|id$|ref$", re.I)


Span = tuple[int, int, str]


def _line_spans(line: str, words: dict[str, float]) -> list[Span]:
    """Credentials whose context is on the same line."""
    found: list[Span] = []

    def add(m: re.Match, group: str, weight: int, quoted: bool, kind: str) -> None:
        if judge(m.group(group), weight, quoted, words):
            found.append((*m.span(group), kind))

    low = line.lower()
    if len(line) > 27 and ("=" in line or ":" in line):
        for m in _NEUTRAL.finditer(line):
            if not name_weight(m.group("name")) and not _PUBLIC.search(m.group("name")):
                add(m, "value", 0, True, "assignment")
    if not any(h in low for h in _HINTS):
        return found
    if "-----begin" in low:
        for m in _PEM.finditer(line):
            found.append((*m.span(), "private_key"))
        if found:
            return found
    if "@" in line:
        for m in _USERINFO.finditer(line):
            add(m, "value", 3, True, "address")
    if "jdbc" in low:
        for m in _JDBC_THIN.finditer(line):
            add(m, "value", 3, True, "address")
    if "-u" in line:
        for m in _CURL_USER.finditer(line):
            add(m, "value", 3, True, "command")
    if "-" in line:
        for m in _FLAG.finditer(line):
            if w := name_weight(m.group("name")):
                add(m, "value", w, bool(m.group("q")), "command")
        for m in _COMMAND.finditer(line):
            add(m, "value", 3, True, "command")
    if any(h in low for h in ("bearer", "basic", "token", "digest")):
        for m in _SCHEME.finditer(line):
            if residual(m.group("value"), words) >= 6 and is_literal(m.group("value")):
                found.append((*m.span("value"), "header"))
    if "(" in line:
        for m in _LOGIN_CALL.finditer(line):
            add(m, "value", 3, True, "command")
    if "/" in line:
        for m in _LOGIN_SAID.finditer(line):
            if re.search(r"\d", m.group("value")) or residual(m.group("value"), words) >= 5:
                add(m, "value", 3, True, "comment")
    if "value" in low:
        for m in _PAIR.finditer(line):
            if w := name_weight(m.group("name")):
                add(m, "value", w, True, "assignment")
    if "</" in line:
        for m in _XML.finditer(line):
            if w := name_weight(m.group("name")):
                add(m, "value", w, True, "assignment")
    at = 0
    while m := _ASSIGN.search(line, at):
        at = m.start() + 1 if not name_weight(m.group("name")) else m.end()
        group = "quoted" if m.group("vq") else "bare"
        if group == "quoted" and not name_weight(m.group("name")):
            at = m.start("quoted")  # connection strings hold assignments of their own
        elif w := name_weight(m.group("name")):
            add(m, group, w, group == "quoted", "assignment")
        if at <= m.start():
            at = m.start() + 1
        if group == "bare" and not name_weight(m.group("name")):
            at = m.start("bare")
    for m in _SPACED.finditer(line):
        v = m.group("value")
        if (w := name_weight(m.group("name"))) >= 2 and re.search(r"[A-Za-z]", v) and (re.search(r"\d", v) or residual(v, words) >= 7):
            add(m, "value", w, True, "comment")
    return found


def scan(text: str, words: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """(line number from 1, start, end, kind) of each credential; start and end count within the line."""
    out: list[tuple[int, int, int, str]] = []
    pending: tuple[str, int, int] | None = None  # how a name leaves its value to a later line, its weight, the least indent of that line
    inside_key = False
    lines = [raw.removesuffix("\r") for raw in text.split("\n")]
    for no, line in enumerate(lines, 1):
        if inside_key:
            inside_key = "-----END" not in line
            continue
        # pieces are joined where a literal begins, not again on each of its lines
        whole = line if no > 1 and _CONTINUED.search(lines[no - 2]) else _joined(lines, no - 1)
        spans = [(s, min(e, len(line)), k) for s, e, k in _line_spans(whole, words)]
        if pending and not spans:
            kind, weight, indent = pending
            m = _VALUED.search(line) if kind == "named" else _LITERAL_LINE.match(line)
            if m and len(line) - len(line.lstrip()) >= indent and judge(m.group("value"), weight, True, words):
                spans = [(*m.span("value"), "assignment")]
        if line.strip():
            pending = None
        if (m := _NAMED.search(line)) and (w := name_weight(m.group("name"))):
            pending = ("named", w, 0)
        elif (m := _FOLDED.search(line) or _XML_OPEN.match(line)) and (w := name_weight(m.group("name"))):
            # a bare name at the end of its line is empty unless the next line is indented below it
            pending = ("folded", w, 0 if line.rstrip()[-1] not in ":=" else len(line) - len(line.lstrip()) + 1)
        for start, end, kind in _merged(spans):
            out.append((no, start, end, kind))
            if kind == "private_key" and "-----END" not in line[end:]:
                inside_key = True
    return out


def _joined(lines: list[str], at: int) -> str:
    """The line, with the pieces of a literal that is concatenated over the next lines in place."""
    line, pieces = lines[at], []
    while (m := _CONTINUED.search(line)) and at + 1 < len(lines) and (n := _PIECE.match(lines[at + 1])):
        at += 1
        pieces.append(line[: m.start("end")])
        line = n.group("rest")
    return "".join(pieces) + line


def _merged(spans: list[Span]) -> list[Span]:
    """Without spans that overlap an earlier one."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def scan_path(path: str, words: dict[str, float]) -> list[Span]:
    """Credentials in a path: assignments and user info in its components, or a component that no dictionary explains."""
    spans: list[Span] = []
    at = 0
    parts = path.split("/")
    for i, part in enumerate(parts):
        git_object = i and re.fullmatch("[0-9a-f]{2}", parts[i - 1]) and re.fullmatch("[0-9a-f]{38}|[0-9a-f]{62}", part)
        other_hash = _HASH.fullmatch(part) and len(part) > 32
        if len(part) >= 18 and not git_object and not other_hash and not _UUID.fullmatch(part) and "=" not in part and ":" not in part:
            digits, upper = sum(c.isdigit() for c in part), sum(c.isupper() for c in part)
            if residual(part, words) >= 14 and digits + upper >= 4:
                spans.append((at, at + len(part), "path"))
        spans += [(at + s, at + e, k) for s, e, k in _line_spans(part, words) if k in ("assignment", "address")]
        at += len(part) + 1
    return _merged(spans)


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with each credential replaced inside its quotes; of a private key in several lines the body goes, the marks stay."""
    lines = text.split("\n")
    for no, start, end, kind in reversed(spans):
        line = lines[no - 1]
        if kind != "private_key":
            lines[no - 1] = line[:start] + "<redacted>" + line[end:]
            continue
        tail = line.find("-----END", end)
        if tail != -1:
            lines[no - 1] = line[:end] + "<redacted>" + line[tail:]
            continue
        last = next((k for k in range(no, len(lines)) if "-----END" in lines[k]), len(lines))
        if last > no:
            indent = re.match(r"\s*", lines[no]).group()
            lines[no:last] = [indent + "<redacted>" + ("\r" if lines[no].endswith("\r") else "")]
    return "\n".join(lines)


_DDL = "file_id bigint, line_no int, start_pos int, end_pos int, kind string"
_FOUND = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string())])


def find_credentials(files: DataFrame, words_file: str = WORDS_FILE) -> DataFrame:
    """(file_id, line_no, start_pos, end_pos, kind) of every credential; line 0 is the path.

    Edge cases: null and empty texts and paths have none; of a key in several lines the BEGIN line counts, of a value in
    several pieces the first; repeated files are reported under each ``file_id``; an empty table gives an empty table;
    further columns are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(words_file)
        for b in it:
            rows = []
            for file_id, path, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "relative_path", "text")), strict=True):
                rows += [(file_id, 0, *s) for s in scan_path(path or "", words)]
                rows += [(file_id, *s) for s in scan(text or "", words)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    return spread(files.select("file_id", "relative_path", "text"), "file_id").mapInArrow(batches, _DDL)


def redacted_files(files: DataFrame, words_file: str = WORDS_FILE) -> DataFrame:
    """Every file with its credentials replaced: (file_id, relative_path, text, n_credentials); null texts stay null."""
    schema = pa.schema([("file_id", pa.int64()), ("relative_path", pa.string()), ("text", pa.string()), ("n_credentials", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(words_file)
        for b in it:
            rows = []
            for file_id, path, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "relative_path", "text")), strict=True):
                in_path, in_text = scan_path(path or "", words), scan(text or "", words)
                for start, end, _ in reversed(in_path):
                    path = path[:start] + "redacted" + path[end:]
                rows.append((file_id, path, text and redact(text, in_text), len(in_path) + len(in_text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return spread(files.select("file_id", "relative_path", "text"), "file_id").mapInArrow(batches, "file_id bigint, relative_path string, text string, n_credentials int")
