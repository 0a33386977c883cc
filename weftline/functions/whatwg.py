"""URLs that needn't be normal: a small parser for tasks, for http(s) as browsers read them."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit, urlunsplit

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
_DEFAULT_PORTS = {"http": 80, "https": 443}


#: What a URL may have around it: controls and blanks.
_BLANKS = "".join(map(chr, range(0x21)))


def _forward(url: str) -> str:
    """Backslashes before the query are slashes."""
    end = re.search(r"[?#]|$", url).start()
    return url[:end].replace("\\", "/") + url[end:]


def _joined(value: str, base: str | None) -> str:
    """A reference put behind what its base gives it; dot segments stay."""
    scheme, colon, rest = value.partition(":") if _SCHEME.match(value) else ("", "", value)
    if colon and (base is None or scheme.lower() != base.partition(":")[0].lower() or rest.startswith("/")):
        return f"{scheme}://{rest.lstrip('/')}"
    if base is None:
        raise ValueError(f"no base: {value[:80]}")
    own, _, after = base.partition(":")
    place, path, query = re.match(r"/*([^/?#]*)([^?#]*)(\?[^#]*)?", after).groups()
    if rest.startswith("//"):
        return f"{own}://{rest.lstrip('/')}"
    if rest.startswith("/"):
        return f"{own}://{place}{rest}"
    if rest[:1] in ("", "#"):
        return f"{own}://{place}{path}{query or ''}{rest}"
    return f"{own}://{place}{path if rest[:1] == '?' else (path or '/').rpartition('/')[0] + '/'}{rest}"


#: Absolute URLs that the parser leaves as they are: no port, no escape, no empty query or fragment; dot segments are looked for apart.
_NORMAL = re.compile(r"https?://(?:[A-Za-z0-9]+(?::[A-Za-z0-9]+)?@)?[a-z0-9.-]+/[A-Za-z0-9._~!$&()*+,;=:@/-]*(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]+)?(?:#[A-Za-z0-9._~!$&()*+,;=:@/?-]+)?")


def parsed(value: str, base: str | None = None) -> str:
    """The absolute URL with its fragment; ValueError if there is none."""
    if _NORMAL.fullmatch(value) and "/." not in value:
        return value
    value = re.sub(r"[\t\n\r]", "", value.strip(_BLANKS))
    if not _SCHEME.match(value) and not base:
        raise ValueError(f"not a URL: {value[:80]}")
    if _SCHEME.match(value) and not re.match(r"^https?:", value, re.I):
        scheme, rest = value.split(":", 1)
        return f"{scheme.lower()}:{rest}"
    full = _joined(_forward(value), _forward(base.strip(_BLANKS)) if base else None)
    parts = urlsplit(full)
    host, port = (parts.hostname or "").lower(), parts.port
    if not host:
        raise ValueError(f"no host: {value[:80]}")
    at = parts.netloc.rpartition("@")[0]
    place = (f"{at}@" if at else "") + (f"[{host}]" if ":" in host else host) + (f":{port}" if port is not None and port != _DEFAULT_PORTS.get(parts.scheme.lower()) else "")
    folders: list[str] = []
    pieces = parts.path.split("/")[1:]
    for n, piece in enumerate(pieces):
        last = n == len(pieces) - 1
        if piece.lower() in ("..", "%2e%2e", ".%2e", "%2e."):
            folders[-1:] = []
            folders += [""] if last else []
        elif piece.lower() in (".", "%2e"):
            folders += [""] if last else []
        else:
            folders.append(piece)
    path = quote("/" + "/".join(folders), safe="/%:@!$&'()*+,;=~-._|[]^")
    return urlunsplit((parts.scheme.lower(), place, path, quote(parts.query, safe="%:@!$&()*+,;=/?~-._|[]^`{}\\"), quote(parts.fragment, safe="%:@!$&'()*+,;=/?~-._#[]^|{}\\")))


def normalized(value: str, base: str | None = None) -> str:
    """Without fragment."""
    return parsed(value, base).partition("#")[0]


def reference(raw: str, base: str | None) -> tuple[str, str, str] | None:
    """(kind, URL, normalized URL) of a reference: fragment, embedded, non-fetch or network; None for a blank one."""
    if not raw or not raw.strip():
        return None
    if raw.startswith("#"):
        return "fragment", raw, ""
    url = parsed(raw, base)
    scheme = url.split(":", 1)[0]
    if scheme in ("data", "blob"):
        return "embedded", url, url
    if scheme not in ("http", "https"):
        return "non-fetch", raw, ""
    return "network", url, url.partition("#")[0]
