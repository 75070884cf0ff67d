"""Plain Python for what Spark's own functions cannot express: URL resolution, entities, compatibility forms."""

from __future__ import annotations

import ipaddress
import posixpath
import re
import unicodedata
from urllib.parse import parse_qs, quote

_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#/<>?@\[\\\]^|%\x7f]")
_NAMED = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def decode_entities(text: str) -> str | None:
    """The entities that the engine knows, in order, so that ``&amp;lt;`` becomes ``<``. None if a code point is out of range."""
    for name, char in _NAMED:
        text = text.replace(name, char)
    text = re.sub(r"(?i)&#x27;", "'", text)
    text = re.sub(r"(?i)&#x2f;", "/", text)

    def char(code: int) -> str:
        if code > 0x10FFFF:
            raise ValueError
        return "�" if 0xD800 <= code < 0xE000 else chr(code)

    try:
        text = re.sub(r"&#([0-9]+);", lambda m: char(int(m[1][:12])), text)
        return re.sub(r"(?i)&#x([0-9a-f]+);", lambda m: char(int(m[1][:12], 16)), text)
    except ValueError:
        return None


def unmarked(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M")


def slug(text: str, fallback: str = "page") -> str:
    text = unmarked(decode_entities(text) or "")
    text = re.sub(r"['’]", "", text).replace("&", " and ")
    return re.sub(r"[^a-zA-Z0-9]+", "-", text).strip("-").lower() or fallback


def _segments(path: str) -> str:
    """Resolve dot segments of an absolute path."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        plain = re.sub(r"(?i)%2e", ".", part)
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(part)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def _number(part: str) -> int | None:
    """A part of a numeric host: decimal, octal after 0 or hexadecimal after 0x. None if it is no number."""
    digits, base = (part[2:], 16) if part[:2].lower() == "0x" else (part[1:], 8) if len(part) > 1 and part[0] == "0" else (part, 10)
    if not digits:
        return 0 if base == 16 else None
    allowed = "0123456789abcdef"[:base]
    return int(digits, base) if all(c in allowed for c in digits.lower()) else None


def _numeric(text: str) -> str | None:
    """A host as it is, but for one that ends in a number: that is an address of four bytes, whose last part may stand for several. None if it is too large or no address."""
    parts = text.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not parts[-1] or not (all(c in "0123456789" for c in parts[-1]) or _number(parts[-1]) is not None):
        return text
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    whole = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(whole >> shift & 255) for shift in (24, 16, 8, 0))


def _six(text: str) -> str | None:
    """An address of sixteen bytes in its short form; None if it is none."""
    try:
        groups = ipaddress.IPv6Address(text).exploded.split(":") if "%" not in text else None
    except ValueError:
        return None
    if groups is None:
        return None
    # of the longest runs of zero groups the first gives way to "::"
    plain = ":".join(f"{int(g, 16):x}" for g in _hex_groups(groups))
    runs = sorted(((-len(m[0].split(":")), m.start(), m.end()) for m in re.finditer(r"(?<![0-9a-f])0(?::0)+(?![0-9a-f])", plain)))
    if not runs:
        return plain
    _, a, b = runs[0]
    return f"{plain[:a].removesuffix(':')}::{plain[b:].removeprefix(':')}"


def _hex_groups(groups: list[str]) -> list[str]:
    """The groups, the last two from dotted bytes if they are written so."""
    if "." not in groups[-1]:
        return groups
    a, b, c, d = map(int, groups[-1].split("."))
    return [*groups[:-1], f"{a << 8 | b:x}", f"{c << 8 | d:x}"]


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        short = _six(text[1:-1]) if text.endswith("]") else None
        return None if short is None else f"[{short}]"
    if not special:
        return None if re.search(r"[\x00\t\n\r #/<>?@\[\\\]^|]", text) else quote(text, safe="!$&'()*+,;=:-._~%\"{}`")
    try:
        from urllib.parse import unquote

        text = unquote(text, errors="strict")
        text = text.encode("idna").decode() if not text.isascii() else text
    except (UnicodeError, ValueError):
        return None
    text = text.lower()
    return None if not text or _BAD_HOST.search(text) else _numeric(text)


def resolve(base: str | None, href: str) -> str | None:
    """Resolve as browsers do: case, default ports, dot segments and percent-encoding are normalized. None if it can't be."""
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    found = _SCHEME.match(href)
    if found:
        scheme, rest = found[1].lower(), href[found.end() :]
        special = scheme in _PORTS
        if special and base and not re.match(r"[/\\]", rest) and base.lower().startswith(scheme + ":"):
            return resolve(base, rest)  # "https:path" is relative to a base of that scheme
        if not special and scheme != "file":
            body, hash_, fragment = rest.partition("#")
            if body.startswith("//"):
                authority, slash, tail = body[2:].partition("/")
                host = _host(authority, False)
                if host is None:
                    return None
                body = "//" + host + (_segments(slash + tail) if slash else "")
            return f"{scheme}:{quote(body, safe=_BODY)}{hash_}{quote(fragment, safe=_FRAGMENT)}"
        rest = rest.replace("\\", "/") if "?" not in rest and "#" not in rest else re.sub(r"\\(?=[^?#]*)", "/", rest.split("?")[0].split("#")[0]) + rest[len(rest.split("?")[0].split("#")[0]) :]
        rest = rest.lstrip("/")
        end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        return _special(scheme, rest[:end], rest[end:])
    if not base or not (whole := _SCHEME.match(base)):
        return None
    scheme = whole[1].lower()
    if scheme not in _PORTS:
        return base.split("#")[0] + quote(href, safe=_FRAGMENT + "#") if href.startswith("#") else None
    rest = base[whole.end() :].lstrip("/")
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    authority, tail = rest[:end], rest[end:]
    path, query = re.split(r"[?#]", tail)[0] or "/", (re.search(r"\?[^#]*", tail.split("#")[0]) or [""])[0]
    plain = re.split(r"[?#]", href)[0]
    href = plain.replace("\\", "/") + href[len(plain) :]
    if href.startswith("//"):
        body = href.lstrip("/")
        end = min((i for i in (body.find(c) for c in "/?#") if i >= 0), default=len(body))
        return _special(scheme, body[:end], body[end:])
    if href.startswith("/"):
        return _special(scheme, authority, href)
    if href.startswith("?"):
        return _special(scheme, authority, path + href)
    if not href or href.startswith("#"):
        return _special(scheme, authority, path + query + href)
    return _special(scheme, authority, path[: path.rfind("/") + 1] + href)


_BODY = "!$&'()*+,;=:@/-._~%?\"<>[\\]^`{|} "
_PATH = "!$&'()*+,;=:@/-._~%[\\]|"
_QUERY = "!$&()*+,;=:@/?-._~%[\\]^`{|}"
_FRAGMENT = "!$&'()*+,;=:@/?-._~%[\\]^{|}#"


def _special(scheme: str, authority: str, tail: str) -> str | None:
    user, at, place = authority.rpartition("@")
    port = re.search(r":([0-9]*)$", place)
    if port is None and re.search(r":[^\]]*$", place) and not place.startswith("["):
        return None
    name = _host(place[: port.start()] if port else place, True)
    if name is None or (port and port[1] and int(port[1]) > 65535):
        return None
    number = str(int(port[1])) if port and port[1] else ""
    host = name + (f":{number}" if number and number != _PORTS[scheme] else "")
    rest, hash_, fragment = tail.partition("#")
    path, mark, query = rest.partition("?")
    login = f"{quote(user, safe=':!$&()*+,;=%-._~')}@" if at and user else ""
    path = _segments(quote(path if path.startswith("/") else "/" + path, safe=_PATH))
    return f"{scheme}://{login}{host}{path}{mark}{quote(query, safe=_QUERY)}{hash_}{quote(fragment, safe=_FRAGMENT)}"


def normalize(base: str | None, href: str | None) -> str | None:
    """A link's address, or None for links that lead to no document."""
    if not href:
        return None
    plain = decode_entities(href.strip())
    if not plain or plain.startswith(("#", "javascript:", "mailto:")):
        return None
    return resolve(base, plain)


def asset_address(base: str | None, src: str | None) -> str | None:
    """An image's address; that of the picture behind an image optimizer's route."""
    url = normalize(base, src)
    found = re.match(r"[a-z]+://[^/?#]*/_next/image\?([^#]*)", url or "")
    if found and "url" in (args := parse_qs(found[1], keep_blank_values=True)):
        return normalize(base, args["url"][0])
    return url


def relative_path(origin: str, target: str) -> str:
    return posixpath.relpath(target, posixpath.dirname(origin) or ".")
