"""Bytes of a response to text: content decompression with limits, and the declared character set.

A byte order mark wins over the charset of the Content-Type header, that over the first supported ``<meta>`` within the
first 1024 bytes, that over UTF-8. Nothing is guessed. Null bodies decode to null.
"""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd
from pyspark.sql import functions as F

from marginalia.functions.types import BINARY, FLAG, TEXT, struct

META_BYTES = 1024

# Labels of the web's encoding standard by the Python codec that decodes them.
LABELS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8",
    "gb18030": "gb18030 gbk gb2312 gb_2312 gb_2312-80 chinese csgb2312 csiso58gb231280 iso-ir-58 x-gbk",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "cp932": "shift_jis shift-jis sjis x-sjis ms932 ms_kanji csshiftjis windows-31j",
    "euc_jp": "euc-jp x-euc-jp cseucpkdfmtjapanese",
    "iso2022_jp": "iso-2022-jp csiso2022jp",
    "cp949": "euc-kr cseuckr korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949 csksc56011987 iso-ir-149",
    "cp1252": "windows-1252 cp1252 x-cp1252 ascii us-ascii ansi_x3.4-1968 iso-8859-1 iso8859-1 iso88591 iso_8859-1 latin1 l1 cp819 ibm819 csisolatin1 iso-ir-100",
    "cp1254": "windows-1254 cp1254 x-cp1254 iso-8859-9 iso8859-9 iso88599 iso_8859-9 latin5 l5 csisolatin5 iso-ir-148",
    "cp874": "windows-874 dos-874 iso-8859-11 iso8859-11 iso885911 tis-620",
    "koi8_r": "koi8-r koi koi8 koi8_r cskoi8r",
    "koi8_u": "koi8-u koi8-ru",
    "cp866": "ibm866 866 cp866 csibm866",
    "mac_roman": "macintosh mac x-mac-roman csmacintosh",
    "mac_cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "utf-16-le": "utf-16le utf-16 unicode ucs-2 csunicode iso-10646-ucs-2 unicodefeff",
    "utf-16-be": "utf-16be unicodefffe",
}
_CODEC = {label: codec for codec, labels in LABELS.items() for label in labels.split()}
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_PARAM = re.compile(r""";\s*charset\s*=\s*(?:"([^"]*)"|'([^']*)'|([^;\s]+))""", re.I)
_RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<plaintext\b.*|<({_RAW})\b.*?(?:</\1\b[^>]*>|\Z)|<meta\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def codec_of(label: str | None) -> str | None:
    """Python codec of a web encoding label; None if it is not supported."""
    label = (label or "").strip(" \t\n\f\r").lower()
    if label in _CODEC:
        return _CODEC[label]
    if m := re.fullmatch(r"(?:windows-|x-cp|cp)(125[0-8])", label):
        return "cp" + m[1]
    if m := re.fullmatch(r"iso[-_]?8859[-_]?(2|3|4|5|6|7|8|10|13|14|15|16)(?:-[ei])?", label):
        return "iso8859_" + m[1]
    return None


def header_charset(content_type: str | None) -> str | None:
    m = _PARAM.search(content_type or "")
    return next((g for g in m.groups() if g is not None), None) if m else None


def meta_codec(head: str) -> str | None:
    """Codec of the first meta tag with a supported label; tags in comments and raw text do not count."""
    for token in _TOKEN.finditer(head):
        if token[2] is None:
            continue
        found: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(token[2]):
            found.setdefault(name.lower(), next((v for v in values if v), ""))
        label = found.get("charset")
        if label is None and found.get("http-equiv", "").lower() == "content-type":
            label = header_charset(";" + found.get("content", ""))
        codec = codec_of(label)
        if codec:
            return "utf-8" if codec.startswith("utf-16") else codec  # the tag was readable as single bytes
    return None


def decode(body: bytes, content_type: str | None = None) -> tuple[str, str, str, bool]:
    """(text, codec, source of the declaration, whether bytes had to be replaced)."""
    codec, source = None, "default"
    for mark, name in _MARKS:
        if body.startswith(mark):
            codec, source, body = name, "bom", body[len(mark) :]
            break
    if codec is None and (codec := codec_of(header_charset(content_type))):
        source = "http"
    if codec is None and (codec := meta_codec(body[:META_BYTES].decode("latin-1"))):
        source = "meta"
    codec = codec or "utf-8"
    try:
        return body.decode(codec), codec, source, False
    except UnicodeDecodeError:
        return body.decode(codec, "replace"), codec, source, True


def inflate(body: bytes, encoding: str, limit: int) -> bytes:
    """The content of a gzip (of any number of members), zlib or raw deflate body; ValueError if it is cut off, goes on after
    its end, or holds more than limit bytes."""
    encoding = (encoding or "identity").strip().lower()
    if encoding in ("", "identity"):
        if len(body) > limit:
            raise ValueError("too large")
        return body
    if encoding in ("gzip", "x-gzip"):
        bits = 31
    elif encoding == "deflate":
        bits = 15 if len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0 else -15
    else:
        raise ValueError("unknown content encoding")
    out, rest = bytearray(), body
    while True:
        member = zlib.decompressobj(bits)
        try:
            out += member.decompress(rest, limit + 1 - len(out))
        except zlib.error as error:
            raise ValueError("damaged") from error
        if len(out) > limit:
            raise ValueError("too large")
        if not member.eof:
            raise ValueError("cut off")
        rest = member.unused_data
        if not rest:
            return bytes(out)
        if bits != 31:
            raise ValueError("data after the end")


#: Bytes of a page that are read at most.
MAX_PAGE = 32 << 20


@F.pandas_udf(struct(text=TEXT, encoding=TEXT, source=TEXT, had_errors=FLAG))
def decode_udf(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """decode() of each body."""
    rows = [decode(bytes(b), t) if b is not None else (None, None, None, None) for b, t in zip(body, content_type)]
    return pd.DataFrame(rows, columns=["text", "encoding", "source", "had_errors"])


@F.pandas_udf(struct(body=BINARY, error=TEXT))
def inflate_udf(body: pd.Series, content_encoding: pd.Series) -> pd.DataFrame:
    """inflate() of each body, or the reason why it cannot be read; at most MAX_PAGE bytes."""

    def one(raw: bytes | None, how: str | None) -> tuple[bytes | None, str | None]:
        try:
            return (None if raw is None else inflate(bytes(raw), how or "", MAX_PAGE)), None
        except ValueError as error:
            return None, str(error)

    return pd.DataFrame([one(b, e) for b, e in zip(body, content_encoding)], columns=["body", "error"])
