"""Credentials embedded in code, configuration and documentation.

Texts are parsed (`formats`) into entries: key paths with the byte offsets of their values. An entry is a credential if its key's
words name one and its value's shape isn't that of a placeholder, a reference or plain talk. Values of entries, literals and
statements may also be typed: private keys, URLs with a login, authorization headers, tokens of a known form. In statements
(comments, prose) words are weighed by their shape and by what the statement speaks of. Redactions are spliced into the bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstone.llm import formats
from threadstone.llm.formats import Entry


class Finding(NamedTuple):
    """A credential: offsets in bytes of the UTF-8 text, end exclusive."""

    start: int
    end: int
    kind: str
    path: str


# Key words and value forms.
PASSWORD_WORDS = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "passwort", "kennwort", "contraseña", "secret", "credential", "credentials", "creds"}
TOKEN_WORDS = {"token", "apikey", "authtoken", "accesstoken"}
KEY_OWNERS = {"api", "secret", "signing", "private", "access", "account", "encryption", "auth", "master", "shared", "storage", "service", "client", "webhook", "app", "deploy"}
QUALIFIERS = {"base", "prod", "production", "staging", "dev", "live", "value", "plain", "b64"}
PLACEHOLDERS = {
    "password", "passwd", "pass", "secret", "token", "key", "apikey", "none", "null", "nil", "true", "false", "default", "prompt", "required", "optional",
    "unset", "empty", "keychain", "test", "string", "value", "undefined",
}
_PLACEHOLDER = re.compile(r"(?i)change.?me|place.?holder|^insert[-_ ]|^your[-_ ]|[-_ ]here$|^example|^dummy|^sample|^todo|^tbd|^fixme|^replace|redacted|^enter[-_ ]|^fake|^mock|^(.)\1+$|^[x*.#_-]+$")
_REFERENCE = re.compile(
    r"^(?:\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|%\(\w+\)s|%\w+%|\{\{.*\}\}|\{%.*%\}|\{\w*\}|<[^<>]*>|\[[^\]]*\]|`.*`|@\w+@|&\w+;?|\*\w+)$"
    r"|^(?:env|vault|file|ref|ssm|arn|secrets?|secretsmanager|op|keyring|keychain|gcp|aws|azure|sops|os|process|config|settings|getenv)[:.(]"
    r"|^!\w+ |^/run/|^/etc/|^/var/|getenv|environ|\bENV\["
)
_TOKEN = re.compile(
    rb"(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|[sr]k_live_\w{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{24,}"
    rb"|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{30,}|pypi-[\w-]{30,}|dop_v1_[0-9a-f]{40,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![\w-])"
)
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.*?-----END \1-----", re.S)
_URL = re.compile(rb"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@\"'<>`]*:([^\s/@\"'<>`]+)@[^\s@\"'<>`]")
_AUTH = re.compile(rb"(?i)\b(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"'`]?\s*(?:basic|bearer|token|digest|apikey|negotiate|ntlm|hmac|aws4-hmac-sha256)\s+([^\"'`\n]+)")
_AUTH_END = re.compile(rb"\s*(?:</.*|\*/|-->|\\n.*)$")
#: What every key of a credential holds somewhere.
_KEYED = re.compile(rb"(?i)pass|pw|secret|token|key|cred|auth|kennwort|contrase")
#: What a statement about logging in speaks of, and the names of users in it.
_LOGIN = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code|wort)?|pwd?|kennwort|secrets?|tokens?|api.?keys?|credentials?|creds|log(?:ged|s|ging)?[\s-]?in(?:to)?|sign(?:ed|s)?[\s-]?in|user(?:name)?|account|auth\w*|unauthori[sz]ed|40[13])\b")
_PASSWORD = r"(?:pass(?:word|wd|phrase|code|wort)?|pwd?|kennwort|contraseña)"
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+")


def words(key: str) -> list[str]:
    """The words of a key in any naming style, in lower case."""
    return [w.lower() for w in _CAMEL.findall(key)]


def key_class(key: str) -> str | None:
    """'password', 'token' or 'auth' if the key names a credential, else None. What the key ends with decides, so that a
    password's minimal length, a token count, a token type or a public key is none; numbers and qualifiers at the end don't count."""
    w = words(key)
    while len(w) > 1 and (w[-1].isdigit() or w[-1] in QUALIFIERS):
        w.pop()
    if not w:
        return None
    last, before = w[-1], w[-2] if len(w) > 1 else ""
    if last == "authorization":
        return "auth"
    if last in PASSWORD_WORDS:
        return "password"
    if last in TOKEN_WORDS or last == "key" and before in KEY_OWNERS:
        return "token"
    return None


# ---- shapes of values -----------------------------------------------------------------------------------------------


def is_literal(value: str) -> bool:
    """Neither empty nor a placeholder nor a reference to something kept elsewhere."""
    v = value.strip()
    return bool(v) and v.lower() not in PLACEHOLDERS and not _PLACEHOLDER.search(v) and not _REFERENCE.search(v)


def entropy(v: str) -> float:
    """Bits a character, from the characters' own frequencies."""
    return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0.0


def token_shaped(v: str) -> bool:
    """Long, without blanks, with letters, of mixed classes, and not of a few characters again and again."""
    mixed = any(c.isdigit() for c in v) or v.lower() != v and v.upper() != v
    return len(v) >= 12 and not re.search(r"\s", v) and mixed and bool(re.search(r"[A-Za-z]", v)) and entropy(v) >= 2.0


_ORDINARY = re.compile(
    r"""(?x)
    [A-Za-z]+[.!?:;,]* | \W+                               # words, marks
    | [A-Za-z]{0,3}[+-]?\d[\d.,:x_/-]*[A-Za-z%°µ]{0,6}       # numbers, versions, dates, units, sizes
    | 0x[0-9a-fA-F_]+ | [A-Za-z]+\d{1,3}                     # hexadecimal numbers; names with a number
    | [0-9a-f]{32} | [0-9a-f]{40} | [0-9a-f]{64} | [0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}   # hashes, ids
    | [A-Za-z]+(?:[_-][A-Za-z]+)+ | [a-z]+\d*(?:_[a-z]+\d*)+   # names of several words
    | [\w-]+(?:\.[\w-]+)+ | [\w.-]*/.*[a-z]{3,}[/.].* | .*\\.* | .*://.* | .*@[\w-]+\.[\w.-]+   # dotted names, paths, addresses
    | .*[()\[\]{}<>=|`"';].* | .*::.* | .*\w->\w.* | -.* | .*,.+  # code
    | [A-Z]+\d[\dA-Z]* | \w+/\w+ | [A-Za-z]+[-_]?\d{1,3}[a-z]{0,2}          # types, alternatives
    """
)
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^A-Za-z0-9]+")
_MARKS = "!@#$%^&*~+"


def _humps(v: str) -> float:
    """Characters per run of a class; names of several words have long runs, random characters short ones."""
    return len(v) / max(1, len(_HUMP.findall(v)))


def chosen_shape(v: str) -> bool:
    """Whether a word looks chosen or generated as a credential: characters mixed as neither words nor names, numbers, paths or
    code mix them."""
    if not 6 <= len(v) <= 200 or not is_literal(v) or not re.search(r"[A-Za-z]", v):
        return False
    if re.fullmatch(r"[A-Z]{4,}_\d{4}|[a-z]+(?:-[a-z]+)+-\d{2,}", v):  # words with a number at their end
        return True
    if _ORDINARY.fullmatch(v):
        return False
    digits, marks = any(c.isdigit() for c in v), any(c in _MARKS for c in v[1:])
    mixed = v.lower() != v and v.upper() != v
    if digits and re.search(r"\d[A-Za-z].*\d|[A-Za-z]\d+[A-Za-z]", v):
        return True
    return digits and (marks or mixed and len(v) >= 8) or marks and mixed and len(v) >= 8 or mixed and len(v) >= 8 and _humps(v) <= 2.4


def random_shape(v: str) -> bool:
    """Whether a word can hardly be anything else: small and capital letters and digits in short runs, or with a mark at its end."""
    small, capital, digits = (sum(f(c) for c in v) for f in (str.islower, str.isupper, str.isdigit))
    if len(v) < 9 or not (small and capital and digits) or not chosen_shape(v):
        return False
    return v[-1] in "!^*$%" and v[:-1].isalnum() or small >= 3 and capital >= 3 and _humps(v) <= 2.4


def _credential(path: tuple[str, ...], value: str, quoted: bool, form: str) -> bool:
    if form == "login":
        return is_literal(value)
    kind = key_class(path[-1])
    if kind is None or not is_literal(value):
        return False
    if kind == "token":
        return token_shaped(re.sub(r"\s+", "", value) if form == "block" else value)
    if kind == "password":
        if len(value) < 4 or value.isdigit() and len(value) < 6:
            return False
        if not re.search(r"\s", value):
            return True
        if form in ("literal", "xml") and key_class(path[-1]) and len(value) > 64:
            return False
        return quoted and ("passphrase" in path[-1].lower() or any(re.search(r"\d", w) and chosen_shape(w) or re.fullmatch(r"[A-Za-z]+\d{3,}", w) for w in value.split()))
    return False


# ---- statements -----------------------------------------------------------------------------------------------------

_SETTING = re.compile(r"([^\W\d][\w.\- ]{0,40}?)\s*[:=]\s*([^\s\"'`;]+)\s*(?:\*/|-->)?\s*$")
_INLINE = re.compile(r"(?<![\w-])([^\W\d][\w.-]*)=([^\s\"'`]+)")
_PAIR = re.compile(rf"(?i)\buser(?:name)?\s*[:=]?\s+[\w.@-]+\s*,?\s*(?:and\s+)?(?:with\s+)?{_PASSWORD}\s*[:=]?\s+(\S+?)[,;:)]*(?:\s|$)")
_SLASHED = re.compile(r"(?i)\b(?:log-?\s?in|sign-?\s?in|credentials?|creds|account)\b.*\s[\w.@-]+\s+/\s+(\S+?)[,;:)]*$")
_WORD = re.compile(r"[^\s\"'`<>]+")
_EDGE = re.compile(r"^[(\[]*|[,;:)\]]*$")


def _noted(s: str) -> Iterator[tuple[int, int]]:
    """Places of credentials in a statement: settings written into it, logins given as a pair, words with the shape of a
    credential where it speaks of logging in, and words that can hardly be anything else."""
    if m := _SETTING.match(s):
        if m[1].count(" ") < 2 and _credential((m[1],), m[2], False, "statement"):
            yield m.span(2)
    for m in _INLINE.finditer(s):
        if key_class(m[1]) == "password" and len(m[2]) >= 6 and _credential((m[1],), m[2].rstrip(",;:)"), False, "statement"):
            yield m.start(2), m.start(2) + len(m[2].rstrip(",;:)"))
    about = _LOGIN.search(s)
    if about:
        for p in (_PAIR, _SLASHED):
            if (m := p.search(s)) and len(m[1]) >= 6 and is_literal(m[1]) and not m[1].isdigit():
                yield m.span(1)
    elif not re.search(r"\d", s):
        return
    shaped = chosen_shape if about else random_shape
    for m in _WORD.finditer(s):
        a, b = m.span()
        if b - a < 6:
            continue
        w = m[0]
        a, w = a + len(w) - len(w.lstrip("([")), w.strip("([,;:)]")
        if w.endswith(".") and b >= len(s.rstrip()) and s[:1].isupper():  # the end of a sentence
            w = w[:-1]
        if shaped(w):
            yield a, a + len(w)


#: Armoured blocks and public keys, whose characters are random without being secret.
_PUBLIC = re.compile(rb"-----BEGIN [^\n-]*-----.*?(?:-----END [^\n-]*-----|\Z)|\b(?:ssh-(?:rsa|dss|ed25519)|ecdsa-[\w-]+|sk-[\w-]+@openssh\.com)\s+\S+", re.S)
#: What some word of every statement about logging in, and every key of a credential, holds in lower case.
_CUES = (b"pass", b"pw", b"secret", b"token", b"key", b"cred", b"auth", b"kennwort", b"contrase", b"login", b"log in", b"log-in", b"sign", b"user", b"account", b"401", b"403", b"logged", b"logs")
_KEY_CUES = _CUES[:9]
_FORMS = (b"gh", b"glpat", b"xox", b"k_live", b"npm_", b"hf_", b"AKIA", b"ASIA", b"AIza", b"pypi-", b"dop_v1", b"SG.", b"eyJ")
_DIGIT = re.compile(rb"\d")


def spans(b: bytes) -> list[Finding]:
    """The credentials of a text in UTF-8, by position, without overlaps. Where two meet, private keys go first, then authorization
    headers, keyed values, logins in URLs, tokens of a known form, and what statements tell."""
    if not b:
        return []
    low = b.lower()
    told = any(c in low for c in _CUES)
    url, armour, known = b"://" in b, b"-----BEGIN" in b, any(f in b for f in _FORMS)
    if not (told or url or armour or known or _DIGIT.search(b)):
        return []
    taken, found = bytearray(len(b)), []

    def add(start: int, end: int, kind: str, path: str) -> None:
        if start < end and taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append(Finding(start, end, kind, path))

    for m in _PEM.finditer(b) if armour else ():
        add(m.start(), m.end(), "private_key", "")
    for m in _AUTH.finditer(b) if b"authorization" in low else ():
        value = _AUTH_END.sub(b"", m[1].rstrip())
        if is_literal(value.decode("utf-8", "replace")):
            add(m.start(1), m.start(1) + len(value), "authorization", "authorization")
    keyed = any(c in low for c in _KEY_CUES) or b"curl" in low or b"wget" in low
    values = list(formats.entries(b, _KEYED)) if keyed or formats.fences(b) or b.lstrip()[:1] in (b"{", b"<") else []
    for e in values:
        raw = b[e.start : e.end]
        if b"://" in raw or raw.startswith(b"-----"):
            continue
        if _credential(e.path, raw.decode("utf-8", "replace"), e.quoted, e.form):
            add(e.start, e.end, e.form if e.form in ("option", "header", "login") else "keyed", "/".join(e.path))
    for m in _URL.finditer(b) if url else ():
        if is_literal(m[1].decode("utf-8", "replace")):
            add(m.start(1), m.end(1), "url", "")
    for m in _TOKEN.finditer(b) if known else ():
        add(m.start(), m.end(), "token", "")
    for m in _PUBLIC.finditer(b) if armour or b"ssh-" in b or b"ecdsa-" in b else ():
        taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for start, end in formats.statements(b, values):
        raw = low[start:end]
        if not _DIGIT.search(raw) and not (told and any(c in raw for c in _CUES)):
            continue
        s = b[start:end].decode("utf-8", "replace")
        for i, j in _noted(s):
            if raw.isascii():
                add(start + i, start + j, "statement", "")
            else:
                add(start + len(s[:i].encode()), start + len(s[:j].encode()), "statement", "")
    return sorted(found)


def find(text: str | None) -> list[Finding]:
    """As `spans`, of a string, with offsets in characters. Null and empty texts have no credentials."""
    return _in_characters(text, _bytes(text))[1] if text else []


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _in_characters(text: str, b: bytes) -> tuple[list[Finding], list[Finding]]:
    found = spans(b)
    if len(b) == len(text) or not found:
        return found, found
    out, at, chars = [], 0, 0
    for f in found:  # in order: every byte is decoded once
        chars += len(b[at : f.start].decode("utf-8", "surrogatepass"))
        size = len(b[f.start : f.end].decode("utf-8", "surrogatepass"))
        out.append(Finding(chars, chars + size, f.kind, f.path))
        at, chars = f.end, chars + size
    return found, out


def redact(text: str | None, mark: str = "*") -> tuple[str | None, int]:
    """The text with every credential blacked out, character by character, and how many there are. Line ends stay, and every other
    byte is the original's."""
    if not text:
        return text, 0
    b = _bytes(text)
    found = spans(b)
    if not found:
        return text, 0
    out, last = [], 0
    for f in found:
        hidden = re.sub(r"[^\r\n]", mark, b[f.start : f.end].decode("utf-8", "surrogatepass"))
        out += [b[last : f.start], hidden.encode()]
        last = f.end
    return b"".join([*out, b[last:]]).decode("utf-8", "surrogatepass"), len(found)


def scan(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, start_char, end_char, start_byte, end_byte, kind, key_path``: one row per credential; repeated rows of df count once.
    Whole texts are read; null and empty ones have no credentials; an empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    inner, outer = _in_characters(t, _bytes(t))
                    rows += [(k, c.start, c.end, f.start, f.end, f.kind, f.path) for f, c in zip(inner, outer)]
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [b.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k", "start_char", "end_char", "start_byte", "end_byte", "kind", "key_path"])

    kind = df.schema[key].dataType.simpleString()
    out = f"k {kind}, start_char long, end_char long, start_byte long, end_byte long, kind string, key_path string"
    return df.select(key, text).mapInArrow(run, out).dropDuplicates(["k", "start_char", "end_char"]).withColumnRenamed("k", key)


def redacted(df: DataFrame, text: str = "text", out: str = "redacted", found: str = "n_found") -> DataFrame:
    """df with the redacted text and the number of credentials beside it. Columns called like them are replaced. No shuffle."""
    keep = [c for c in df.columns if c not in (out, found)]
    at = keep.index(text)
    types = [df.schema[df.columns.index(c)].dataType.simpleString() for c in keep]
    schema = ", ".join([f"c{i} {t}" for i, t in enumerate(types)] + ["r string", "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [redact(t) for t in b.column(at).to_pylist()]
            new, n = pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, new, n], names=[*(f"c{i}" for i in range(len(keep))), "r", "n"])

    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])  # names with dots don't reach the batches
    return plain.mapInArrow(run, schema).toDF(*keep, out, found)
