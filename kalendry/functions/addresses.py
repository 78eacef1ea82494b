"""Web addresses as browsers read them: parts, dot segments, default ports, escapes, resolution against a page.

Every function takes and gives columns; an address is taken apart once and the parts are bound, so no pattern runs
twice. Addresses of http, https, ftp, ws and wss are read; of other schemes, and of what cannot be read, the parts are
null. Names beyond ASCII stay as they are (in lower case); escapes that are there stay as they are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the schemes read here with their default ports, and the networks that must not be fetched from (address, bits).
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
PRIVATE = (((0, 0), 8), ((10, 0), 8), ((100, 64), 10), ((127, 0), 8), ((169, 254), 16), ((172, 16), 12), ((192, 168), 16))
_WHOLE = r"(?is)^(https?|ftp|wss?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"


def bound(value: Column, of) -> Column:
    """of(value) with value made once, however often the result names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _escaped(text: Column, more: str) -> Column:
    """Blanks, controls, characters beyond ASCII and those in `more` as %XX of their UTF-8."""
    odd = rf"[^\x21-\x7e]|[{more}]"
    one = lambda c: F.when(c.rlike(rf"(?s)^(?:{odd})$"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(text.rlike(odd), F.concat_ws("", F.transform(F.split(text, ""), one))).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path from / with . and .. taken out by a stack of its segments; .. at the root stays there."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    marked = bound(segments, lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), (i == F.size(s) - 1).alias("last"))))

    def step(stack: Column, s: Column) -> Column:
        up, same = s["x"].rlike(r"(?i)^(?:\.|%2e){2}$"), s["x"].rlike(r"(?i)^(?:\.|%2e)$")
        left = F.when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        end = F.when(s["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(up | same, F.concat(left, end)).otherwise(F.concat(stack, F.array(s["x"])))

    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(_DOTS), folded).otherwise(path)


def ipv4_of(host: Column) -> Column:
    """The 32 bits of a host that is an address in one to four decimal, octal or hexadecimal parts; null for names."""
    number = lambda p: F.when(p.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^[0-9]+$"), p).try_cast("long")

    def of(values: Column) -> Column:
        n = F.size(values)
        high = F.aggregate(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
        last, room = F.try_element_at(values, F.lit(-1)), F.pow(F.lit(256.0), (5 - n).cast("double")).cast("long")
        inner = F.exists(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda v: v > 255)
        fits = n.between(1, 4) & ~F.exists(values, lambda v: v.isNull()) & ~F.coalesce(inner, F.lit(True)) & (last < room)
        return F.when(fits, high * room + last)

    # names need no numbers: most hosts stop at the first test
    return F.when(host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"), bound(F.transform(F.split(host, r"\."), number), of))


def private_ipv4(ip: Column) -> Column:
    return bound(ip, lambda x: reduce(lambda a, b: a | b, [F.shiftrightunsigned(x, 32 - bits) == (((a << 24) | (b << 16)) >> (32 - bits)) for (a, b), bits in PRIVATE]))


def _dotted(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(ip, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])


def parsed(url: Column) -> Column:
    """struct(scheme, user, host, port, path, query, fragment), normal but for the fragment; null if it cannot be read."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def whole(t: Column) -> Column:
        part = [F.regexp_extract(t, _WHOLE, k) for k in range(6)]
        return F.when(t.rlike(_WHOLE), F.struct(F.lower(part[1]).alias("scheme"), part[2].alias("authority"), F.replace(part[3], F.lit("\\"), F.lit("/")).alias("path"), part[4].alias("query"), part[5].alias("fragment")))

    def inside(w: Column) -> Column:
        name = F.lower(F.regexp_extract(w["authority"], _HOST, 2))
        name = F.when(name.contains("%"), F.lower(F.try_url_decode(name))).otherwise(name)
        port = F.regexp_replace(F.regexp_extract(w["authority"], _HOST, 3), "^0+(?=[0-9])", "")
        usual = F.concat_ws("", *[F.when(w["scheme"] == s, p) for s, p in PORTS.items()])
        path = without_dots(_escaped(F.when(w["path"] == "", "/").otherwise(w["path"]), r'"<>`{}^'))

        def with_host(h: Column) -> Column:
            ip = ipv4_of(F.regexp_replace(h, r"\.$", ""))

            def done(i: Column) -> Column:
                number_at_end = h.rlike(r"^(?:[^.]*\.){0,3}(?:[0-9]+|0x[0-9a-f]*)\.?$")  # more parts are taken for a name
                fine = w["authority"].rlike(_HOST) & (h != "") & ~(number_at_end & i.isNull()) & F.coalesce(port.try_cast("int") <= 65535, port == "") & (h.rlike(r"^\[[0-9a-f:.]+\]$") | ~h.rlike(r"[\x00-\x20\x7f#%/<>?@\[\\\]^|:]"))
                return F.when(
                    fine,
                    F.struct(
                        w["scheme"].alias("scheme"),
                        F.regexp_extract(w["authority"], _HOST, 1).alias("user"),
                        F.when(i.isNotNull(), _dotted(i)).otherwise(h).alias("host"),
                        F.when(port != usual, port).otherwise("").alias("port"),
                        path.alias("path"),
                        _escaped(w["query"], "\"<>'").alias("query"),
                        _escaped(w["fragment"], '"<>`').alias("fragment"),
                    ),
                )

            return bound(ip, done)

        return F.when(w.isNotNull(), bound(name, with_host))

    return bound(bound(text, whole), inside)


def _text(p: Column, fragment: bool) -> Column:
    said = lambda c, before="", after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    end = p["fragment"] if fragment else F.lit("")
    return F.concat(p["scheme"], F.lit("://"), said(p["user"], after="@"), p["host"], said(p["port"], before=":"), p["path"], p["query"], end)


def address(url: Column) -> Column:
    """The address as browsers write it, with its fragment."""
    return bound(parsed(url), lambda p: _text(p, True))


def normal(url: Column) -> Column:
    """The address without fragment and without a closing slash, except at the root: the key under which a page is kept."""
    return bound(parsed(url), lambda p: F.when(p["path"] == "/", _text(p, False)).otherwise(F.regexp_replace(_text(p, False), "/$", "")))


def resolved(href: Column, base: Column) -> Column:
    """The address that href names on the page base."""

    def joined(b: Column) -> Column:
        def of(h: Column) -> Column:
            root = F.concat(b["scheme"], F.lit("://"), F.when(b["user"] != "", F.concat(b["user"], F.lit("@"))).otherwise(""), b["host"], F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise(""))
            page = F.concat(root, b["path"])
            return (
                F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
                .when(h.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), h))
                .when(h.rlike(r"^[/\\]"), F.concat(root, h))
                .when(h.startswith("?"), F.concat(page, h))
                .when((h == "") | h.startswith("#"), F.concat(page, b["query"], h))
                .otherwise(F.concat(root, F.regexp_replace(b["path"], "[^/]*$", ""), h))
            )

        return bound(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), of)

    return address(bound(parsed(base), joined))


def refusal(url: Column) -> Column:
    """Why an address must not be fetched (null: it may be): no web scheme, no host that can be read, or a private host."""

    def of(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"\.$", "")
        named = host.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)$")
        six = host.rlike(r"^\[(::1?|::ffff:.*|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)\]$")
        return F.when(p.isNull(), "host").when(named | six | F.coalesce(private_ipv4(ipv4_of(host)), F.lit(False)), "private")

    web = F.coalesce(F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))
    return F.when(~web, "scheme").otherwise(bound(parsed(url), of))
