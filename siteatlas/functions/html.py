"""Page structure as Column expressions.

Flat structure (links, forms, fields, headings, head tags) is read with
patterns inside the JVM, one pass each, no Python worker.  Patterns use
possessive groups, which Java runs as loops, so page size cannot exhaust the
stack.  What needs the element tree is in ``operators.dom``.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.functions.bind import let, let_all

# ---- fixed values -----------------------------------------------------------
# All named references of HTML (those without a semicolon are the legacy ones);
# the ones that pages use most stand first, as a lookup walks the list.
_FREQUENT = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "reg;", "trade;", "middot;", "bull;", "hellip;",
             "ndash;", "mdash;", "laquo;", "raquo;", "lsquo;", "rsquo;", "ldquo;", "rdquo;", "euro;", "pound;", "times;"]
NAMED_REFERENCES = {name: html5[name] for name in [*_FREQUENT, *html5]}
# Numeric references to these C1 codes mean Windows characters.
WINDOWS_1252 = {code: bytes([code]).decode("cp1252") for code in range(0x80, 0xA0)
                if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
ROUTE_ATTRIBUTES = ["data-route", "data-href", "data-url", "data-link", "data-navigate-to",
                    "data-to", "data-path"]
# -----------------------------------------------------------------------------

ATTRS = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
ONE_ATTR = r"""(?:\s+[^\s"'>=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?|\s*+/)"""
BLOCK_TAGS = ("address|article|aside|blockquote|body|center|details|dialog|dir|div|dl|fieldset|figcaption|"
              "figure|footer|form|h[1-6]|header|hgroup|hr|html|main|menu|nav|ol|p|pre|search|section|"
              "summary|table|td|th|tr|ul|li|dt|dd")


def drop_scripts(html: Column) -> Column:
    """HTML without comments, scripts and styles: the ``bare`` text most
    functions here read.  One scan; stage it as a column when several follow.
    """
    return F.regexp_replace(html, r"(?is)<(?:!--.*?-->|(script|style|noscript)\b.*?</\1\s*>)", "")


def empty_scripts(html: Column) -> Column:
    """Script and style tags stay, their text goes."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    return F.regexp_replace(bare, rf"(?is)(<(script|style)(?=[\s/>]){ATTRS}>).*?(</\2\s*>)", "$1$3")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(entries: dict) -> str:
    """A constant map from one literal."""
    return f"str_to_map({_sql(chr(11).join(f'{k}{chr(12)}{v}' for k, v in entries.items()))}, '{chr(11)}', '{chr(12)}')"


# A decoder for many places: one SQL lambda, which is parsed as it stands instead of being put together call by call.
# What follows an ampersand is a number (what is no character becomes U+FFFD), a name, a legacy name, or text.
_LEGACY = "|".join(sorted((n for n in NAMED_REFERENCES if not n.endswith(";")), key=len, reverse=True))
_NAMES = _table(NAMED_REFERENCES)
_CHARACTER = f"""transform(array(CASE WHEN plain = '' THEN 0L WHEN length(plain) <= 8 THEN
    CAST(CASE WHEN lower(substr(digits, 1, 1)) = 'x' THEN conv(plain, 16, 10) ELSE plain END AS BIGINT) END), code -> CASE
  WHEN code IS NULL OR code = 0 OR code = 65535 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN '\ufffd'
  WHEN code BETWEEN 128 AND 159 THEN coalesce(try_element_at({_table(WINDOWS_1252)}, CAST(code AS STRING)), char(code))
  ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END)[0]"""
_REFERENCE = f"""transform(array(named_struct('number', regexp_extract(p, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?', 0),
    'name', regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0))), r -> CASE
  WHEN r.number <> '' THEN concat(transform(array(regexp_replace(r.number, '[#;]', '')), digits ->
    transform(array(regexp_replace(digits, '^[xX]?0*', '')), plain -> {_CHARACTER})[0])[0], substr(p, length(r.number) + 1))
  ELSE transform(array(CASE WHEN r.name <> '' THEN try_element_at({_NAMES}, r.name) END), meant -> CASE
    WHEN meant IS NOT NULL THEN concat(meant, substr(p, length(r.name) + 1))
    ELSE transform(array(regexp_extract(p, '^(?:{_LEGACY})', 0)), short -> CASE
      WHEN short <> '' THEN concat(try_element_at({_NAMES}, short), substr(p, length(short) + 1)) ELSE concat('&', p) END)[0] END)[0] END)[0]"""
_DECODER = f"""text -> CASE WHEN contains(text, '&') THEN transform(array(split(text, '&')), pieces -> concat(pieces[0], array_join(transform(
  slice(pieces, 2, greatest(size(pieces) - 1, 0)), p -> {_REFERENCE}), '')))[0] ELSE text END"""


def decode_entities(text: Column) -> Column:
    """Character references, each decoded once: what a decoded one spells is not decoded again."""
    return F.call_function("transform", F.array(text), F.expr(_DECODER))[0]


def text_of(fragment: Column) -> Column:
    """Text content of a fragment: tags out, entities decoded, ends trimmed."""
    return X.trimmed(decode_entities(F.regexp_replace(fragment, r"(?s)<[^>]*>", "")))


def body_text(html: Column, with_scripts: bool = False) -> Column:
    """Lower-cased text of the body; ``with_scripts`` keeps inline script text."""
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->", "") if with_scripts else drop_scripts(html)
    body = F.regexp_replace(clean, r"(?is)^.*?<body\b[^>]*>|<head\b[^>]*>.*?</head\s*>", "")
    return F.lower(text_of(body))


def open_tags(html: Column, names: str) -> Column:
    """Start tags of the named elements, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>]){ATTRS}>"), 0)


def blocks(html: Column, name: str) -> Column:
    """Elements with their content up to the next end tag of that name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]){ATTRS}>.*?(?:</{name}\s*>|\z)"), 0)


def head_tag(block: Column) -> Column:
    """The start tag of an element block."""
    return F.regexp_extract(block, rf"(?s)^<[^\s/>]+{ATTRS}>", 0)


def inner(block: Column) -> Column:
    return F.regexp_replace(block, rf"(?s)^<[^\s/>]+{ATTRS}>", "")


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1))


def raw_attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(
        tag, rf"""(?is)^<[^\s/>]++{ONE_ATTR}*?\s+{name}\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)


def attr(tag: Column, name: str) -> Column:
    """Attribute value of a start tag; empty when it is missing."""
    return decode_entities(F.regexp_replace(raw_attr(tag, name), r"""(?s)^["']|["']$""", ""))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^<[^\s/>]++{ONE_ATTR}*?\s+{name}(?=[\s=/>])")


def or_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def is_hidden(tag: Column) -> Column:
    """Static stand-in for layout checks on archived pages."""
    return has_attr(tag, "hidden") | F.lower(attr(tag, "style")).rlike(r"display\s*:\s*none")


def first_where(items: Column, test) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))


# ---- head ---------------------------------------------------------------------

def title(bare: Column) -> Column:
    found = F.regexp_extract(bare, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return X.trimmed(F.regexp_replace(decode_entities(found), r"\s+", " "))


def meta(bare: Column) -> Column:
    """map name-or-property -> content; the last tag of a name wins."""
    found = F.transform(open_tags(bare, "meta"), lambda t: F.struct(
        F.coalesce(or_null(attr(t, "name")), attr(t, "property")).alias("key"), attr(t, "content").alias("value")))
    def last_of_each(full: Column) -> Column:
        return F.filter(full, lambda m, i: ~F.exists(
            F.slice(full, i + 2, F.size(full)), lambda later: later.key == m.key))

    full = F.filter(found, lambda m: (m.key != "") & (m.value != ""))
    return F.map_from_entries(let(full, last_of_each))


def head_links(bare: Column, rel: str) -> Column:
    """<link> tags with the given rel."""
    return F.filter(open_tags(bare, "link"), lambda t: F.lower(attr(t, "rel")) == rel)


def canonical(bare: Column, url: Column) -> Column:
    href = or_null(attr(F.try_element_at(head_links(bare, "canonical"), F.lit(1)), "href"))
    return U.resolve(href, url)


def hreflang(bare: Column, url: Column) -> Column:
    found = F.transform(head_links(bare, "alternate"), lambda t: F.struct(
        attr(t, "hreflang").alias("lang"), attr(t, "href").alias("href")))
    full = F.filter(found, lambda a: (a.lang != "") & (a.href != ""))
    placed = let(U.base_of(url), lambda base: F.transform(
        full, lambda a: F.struct(a.lang.alias("lang"), U.resolve_on(a.href, base).alias("url"))))
    return F.filter(placed, lambda a: a.url.isNotNull())


def meta_refresh(bare: Column, url: Column) -> Column:
    tag = first_where(open_tags(bare, "meta"), lambda t: F.lower(attr(t, "http-equiv")) == "refresh")
    target = or_null(X.trimmed(F.regexp_extract(attr(tag, "content"), r"(?i)url=(.+)", 1)))
    return U.resolve(target, url)


def resource_count(html: Column) -> Column:
    tags = open_tags(empty_scripts(html), "script|link|img|video|audio")
    return F.size(F.filter(tags, lambda t: (tag_name(t) != "link") | F.lower(attr(t, "rel")).rlike(
        r"(^|\s)stylesheet(\s|$)")))


def is_spa(html: Column) -> Column:
    """Framework markers that are visible in archived HTML."""
    return let(empty_scripts(html), lambda tags: _spa_marks(html, tags))


def _spa_marks(html: Column, tags: Column) -> Column:
    """Cheap substring tests first; tags are looked at only where they hit."""
    def mount(mark: str, name: str) -> Column:
        hit = F.exists(open_tags(tags, "[a-z][a-z0-9-]*"), lambda t: (attr(t, "id") == name) & has_attr(t, mark))
        return F.when(F.contains(tags, F.lit(mark)), hit).otherwise(F.lit(False))

    def tag_like(mark: str, pattern: str) -> Column:
        return F.when(F.contains(tags, F.lit(mark)), tags.rlike(pattern)).otherwise(F.lit(False))

    chunks = F.exists(open_tags(tags, "script"), lambda t: F.contains(attr(t, "src"), F.lit("chunk")))
    return (F.contains(html, F.lit("__NEXT_DATA__")) | F.contains(html, F.lit("__NUXT__"))
            | tag_like("__next", r"(?is)<[a-z][^>]*\sid\s*=\s*[\"']?__next[\"'\s>]")
            | tag_like("ng-version", r"(?is)<[a-z][^>]*\sng-version(?=[\s=/>])")
            | mount("data-v-app", "app") | mount("data-reactroot", "root")
            | F.when(F.contains(tags, F.lit("chunk")), chunks).otherwise(F.lit(False)))


def status_guess(html: Column) -> Column:
    """Status read from the page text when no response was kept."""
    return let(body_text(html), _status_said)


def _status_said(text: Column) -> Column:
    def says(*parts: str) -> Column:
        hit = F.contains(text, F.lit(parts[0]))
        for part in parts[1:]:
            hit = hit & F.contains(text, F.lit(part))
        return hit

    return (F.when(says("404", "not found"), F.lit(404))
            .when(says("403", "forbidden"), F.lit(403))
            .when(says("500", "server error"), F.lit(500)).otherwise(F.lit(200)))


# ---- body ---------------------------------------------------------------------

def anchors(bare: Column) -> Column:
    """Anchors with an href: array<struct<tag, text>>, in document order."""
    found = F.regexp_extract_all(
        bare, F.lit(rf"(?is)<a(?=\s){ATTRS}>[^<]*+(?:<(?!/?a[\s>])[^<]*+)*+"), 0)
    split = F.transform(found, lambda b: F.struct(head_tag(b).alias("tag"), b.alias("block")))
    return F.transform(F.filter(split, lambda a: has_attr(a["tag"], "href")),
                       lambda a: F.struct(a["tag"].alias("tag"), text_of(inner(a["block"])).alias("text")))


def raw_links(bare: Column) -> Column:
    """array<struct<href, text, hidden>> before resolution."""
    return F.transform(anchors(bare), lambda a: F.struct(
        attr(a.tag, "href").alias("href"), a.text.alias("text"), is_hidden(a.tag).alias("hidden")))


def links_from(raw: Column, url: Column) -> Column:
    """Resolved http links: no fragment, no end slash, no self, first per href."""
    def plain(u: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(u, r"(?s)#.*$", ""), r"/$", "")

    def first_of_each(other: Column) -> Column:
        hrefs = F.transform(other, lambda a: a.href)
        return let(hrefs, lambda seen: F.filter(
            other, lambda a, i: (F.array_position(seen, a.href) == i + 1) & ~a.hidden))

    def placed(base: Column) -> Column:
        found = F.transform(raw, lambda a: F.struct(
            U.resolve_on(a.href, base).alias("href"), F.substring(a.text, 1, 200).alias("text"), a.hidden.alias("hidden")))
        kept = F.transform(F.filter(found, lambda a: a.href.rlike(r"(?i)^https?://")), lambda a: F.struct(
            plain(a.href).alias("href"), a.text.alias("text"), a.hidden.alias("hidden")))
        here = plain(F.concat(base["origin"], base["path"], base["search"]))
        other = let(here, lambda h: F.filter(kept, lambda a: a.href != h))
        return let(other, first_of_each)

    return F.transform(let(U.base_of(url), placed), lambda a: F.struct(a.href.alias("href"), a.text.alias("text")))


def nav_links(bare: Column, limit: int = 50) -> Column:
    """Raw navigation anchors with label fallbacks; first ``limit``."""
    named = F.transform(anchors(bare), lambda a: F.struct(
        a.tag.alias("tag"), a.text.alias("text"), attr(a.tag, "href").alias("href"), attr(a.tag, "id").alias("id")))
    wanted = F.filter(named, lambda a: (a["href"] != "") & (a["href"] != "#") & ~is_hidden(a["tag"])
                      & ~a["href"].rlike(r"^(javascript|mailto):"))
    return F.slice(F.transform(wanted, lambda a: F.struct(
        F.coalesce(or_null(a["text"]), or_null(attr(a["tag"], "aria-label")), or_null(attr(a["tag"], "title")),
                   F.lit("Link")).alias("label"),
        F.when(a["id"] != "", F.concat(F.lit("#"), a["id"])).otherwise(
            F.concat(F.lit('a[href="'), a["href"], F.lit('"]'))).alias("selector"),
        a["href"].alias("href"), attr(a["tag"], "target").alias("target"))), 1, limit)


def headings(bare: Column, levels: str = "1-4", first: int = 20, max_text: int = 200) -> Column:
    """First ``first`` headings, then the non-empty ones of those."""
    found = F.slice(F.regexp_extract_all(
        bare, F.lit(rf"(?is)<h([{levels}])(?=[\s/>]){ATTRS}>.*?</h\1\s*>"), 0), 1, first)
    rows = F.transform(found, lambda b: F.struct(
        F.regexp_extract(b, r"(?i)^<h(\d)", 1).cast("int").alias("level"),
        F.substring(text_of(b), 1, max_text).alias("text")))
    return F.filter(rows, lambda h: h.text != "")


def paragraphs(bare: Column, first: int = 10) -> Column:
    """Paragraph texts cut to 200 characters, more than 20 long, first ten.

    A paragraph ends at its end tag or where a block element starts or ends.
    """
    pieces = F.split(bare, rf"(?is)<p(?=[\s/>]){ATTRS}>")
    texts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring(
        text_of(F.regexp_replace(p, rf"(?is)</?(?:{BLOCK_TAGS})(?=[\s/>]).*$", "")), 1, 200))
    return F.slice(F.filter(texts, lambda t: F.length(t) > 20), 1, first)


# One leading "<" lets the matcher skip text between tags.
CONTROL = (rf"(?is)<(?:input(?=[\s/>]){ATTRS}>|(select|textarea)(?=[\s/>]){ATTRS}>.*?(?:</\1\s*>|\z))")
BUTTON = (rf"(?is)<(?:button(?=[\s/>]){ATTRS}>.*?(?:</button\s*>|\z)|input(?=[\s/>]){ATTRS}>"
          rf"|([a-z][a-z0-9-]*)(?=\s[^>]*role\s*=\s*[\"']?button){ATTRS}>.*?(?:</\1\s*>|\z))")


def control_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(CONTROL), 0)


def control_type(tag: Column) -> Column:
    """type attribute, else the element name."""
    return F.coalesce(or_null(attr(tag, "type")), tag_name(tag))


def form_blocks(bare: Column) -> Column:
    return blocks(bare, "form")


def form_action(tag: Column, url: Column, base: Column) -> Column:
    return let(attr(tag, "action"), lambda raw: F.when(raw == "", url).otherwise(U.resolve_on(raw, base)))


def form_method(tag: Column) -> Column:
    """Anything but post and dialog is a GET form."""
    return let(F.upper(attr(tag, "method")), lambda asked: F.when(
        asked.isin("POST", "DIALOG"), asked).otherwise(F.lit("GET")))


def forms(bare: Column, url: Column) -> Column:
    """array<struct<action, method, inputs>>."""
    def row(b: Column, base: Column) -> Column:
        inputs = F.transform(control_blocks(b), lambda c: let(head_tag(c), lambda tag: F.struct(
            or_null(attr(tag, "name")).alias("name"), control_type(tag).alias("type"),
            has_attr(tag, "required").alias("required"))))
        return let(head_tag(b), lambda tag: F.struct(
            form_action(tag, url, base).alias("action"), form_method(tag).alias("method"), inputs.alias("inputs")))

    return let(U.base_of(url), lambda base: F.transform(form_blocks(bare), lambda b: row(b, base)))


def button_blocks(html: Column, input_types: tuple[str, ...] = ("button", "submit"), roles: bool = True) -> Column:
    """Buttons, button-like inputs and, with ``roles``, role=button elements."""
    def wanted(tag: Column) -> Column:
        role = (F.lower(attr(tag, "role")) == "button") if roles else F.lit(False)
        return ((tag_name(tag) == "button") | role
                | ((tag_name(tag) == "input") & F.lower(attr(tag, "type")).isin(*input_types)))

    return F.filter(F.regexp_extract_all(html, F.lit(BUTTON), 0), lambda b: let(head_tag(b), wanted))


def button_text(block: Column) -> Column:
    return F.coalesce(or_null(text_of(block)), attr(head_tag(block), "value"))


def buttons(bare: Column) -> Column:
    shown = F.filter(button_blocks(bare), lambda b: ~is_hidden(head_tag(b)))
    return F.transform(shown, lambda b: F.struct(
        F.substring(button_text(b), 1, 100).alias("text"), or_null(attr(head_tag(b), "type")).alias("type")))


def labels(bare: Column) -> Column:
    """array<struct<target, text>> of label elements with a ``for``."""
    found = F.transform(blocks(bare, "label"), lambda b: F.struct(
        attr(head_tag(b), "for").alias("target"), text_of(b).alias("text")))
    return F.filter(found, lambda x: x.target != "")


def label_for(known: Column, tag: Column) -> Column:
    """Text of the first label of a control; NULL when it has none."""
    return let(attr(tag, "id"), lambda wanted: F.when(
        wanted != "", or_null(first_where(known, lambda x: x.target == wanted).text)))


def control_value(block: Column) -> Column:
    """Value a control starts with."""
    options = F.transform(F.regexp_extract_all(
        block, F.lit(rf"(?is)<option(?=[\s/>]){ATTRS}>[^<]*+"), 0), lambda o: let(head_tag(o), lambda tag: F.struct(
            has_attr(tag, "selected").alias("selected"),
            F.when(has_attr(tag, "value"), attr(tag, "value")).otherwise(text_of(o)).alias("value"))))
    chosen = let(options, lambda all_of: F.coalesce(
        first_where(all_of, lambda o: o.selected).value, F.try_element_at(all_of, F.lit(1)).value, F.lit("")))
    typed = decode_entities(F.regexp_replace(inner(block), r"(?is)</textarea\s*>$", ""))
    return let(head_tag(block), lambda tag: (
        F.when(tag_name(tag) == "select", chosen).when(tag_name(tag) == "textarea", typed)
        .when(F.lower(attr(tag, "type")).isin("checkbox", "radio") & ~has_attr(tag, "value"), F.lit("on"))
        .otherwise(attr(tag, "value"))))


def select_options(block: Column) -> Column:
    """Non-empty option values."""
    found = F.transform(F.regexp_extract_all(block, F.lit(rf"(?is)<option(?=[\s/>]){ATTRS}>[^<]*+"), 0), lambda o: (
        F.when(has_attr(head_tag(o), "value"), attr(head_tag(o), "value")).otherwise(text_of(o))))
    return F.filter(found, lambda v: v != "")


def form_fields(bare: Column) -> Column:
    """Fields, then buttons, of each form in document order."""
    def field(c: Column, tag: Column, known: Column, n: Column, i: Column) -> Column:
        name = tag_name(tag)
        kind = (F.when(name.isin("select", "textarea"), name)
                .when(F.lower(attr(tag, "type")).isin("checkbox", "radio"), F.lower(attr(tag, "type")))
                .otherwise(F.lit("input")))
        label = F.coalesce(label_for(known, tag), or_null(attr(tag, "aria-label")),
                           or_null(attr(tag, "placeholder")), or_null(attr(tag, "name")), F.lit("Unnamed Field"))
        selector = F.coalesce(
            F.concat(F.lit("#"), or_null(attr(tag, "id"))),
            F.concat(F.lit('[name="'), or_null(attr(tag, "name")), F.lit('"]')),
            F.concat(F.lit("form:nth-of-type("), n + 1, F.lit(") "), name, F.lit(":nth-of-type("), i + 1, F.lit(")")))
        return F.struct(n.alias("form"), kind.alias("kind"), label.alias("label"), attr(tag, "name").alias("name"),
                        attr(tag, "placeholder").alias("placeholder"), has_attr(tag, "required").alias("required"),
                        control_value(c).alias("value"), selector.alias("selector"))

    def press(b: Column, n: Column, i: Column) -> Column:
        selector = F.coalesce(
            F.concat(F.lit("#"), or_null(attr(head_tag(b), "id"))),
            F.concat(F.lit("form:nth-of-type("), n + 1, F.lit(") button:nth-of-type("), i + 1, F.lit(")")))
        return F.struct(n.alias("form"), F.lit("button").alias("kind"),
                        F.coalesce(or_null(button_text(b)), F.lit("Submit")).alias("label"), F.lit("").alias("name"),
                        F.lit("").alias("placeholder"), F.lit(False).alias("required"), F.lit("").alias("value"),
                        selector.alias("selector"))

    def all_forms(known: Column) -> Column:
        return F.flatten(F.transform(form_blocks(bare), lambda b, n: F.concat(
            F.transform(control_blocks(b), lambda c, i: let(head_tag(c), lambda tag: field(c, tag, known, n, i))),
            F.transform(button_blocks(b, ("submit",), roles=False), lambda p, i: press(p, n, i)))))

    return let(labels(bare), all_forms)


def loose_buttons(bare: Column) -> Column:
    """Buttons outside forms, with label fallbacks."""
    parts = F.split(bare, r"(?i)</form(?=[\s>])")

    def flagged(part: Column) -> Column:
        outside = F.regexp_replace(part, r"(?is)<form(?=[\s/>]).*$", "")
        inside = F.regexp_extract(part, r"(?is)<form(?=[\s/>]).*$", 0)
        return F.concat(
            F.transform(button_blocks(outside), lambda b: F.struct(b.alias("block"), F.lit(True).alias("loose"))),
            F.transform(button_blocks(inside), lambda b: F.struct(b.alias("block"), F.lit(False).alias("loose"))))

    numbered = F.transform(F.flatten(F.transform(parts, flagged)), lambda x, i: F.struct(
        x.block.alias("block"), head_tag(x.block).alias("tag"), x.loose.alias("loose"), i.alias("pos")))
    shown = F.filter(numbered, lambda x: x.loose & ~is_hidden(x["tag"]))

    def row(x: Column) -> Column:
        name = tag_name(x["tag"])
        label = F.coalesce(or_null(button_text(x["block"])), or_null(attr(x["tag"], "aria-label")), F.lit("Button"))
        selector = F.coalesce(
            F.concat(F.lit("#"), or_null(attr(x["tag"], "id"))),
            F.concat(name, F.lit('[aria-label="'), or_null(attr(x["tag"], "aria-label")), F.lit('"]')),
            F.concat(name, F.lit(":nth-of-type("), x["pos"] + 1, F.lit(")")))
        return F.struct(label.alias("label"), selector.alias("selector"))

    return F.transform(shown, row)


def frames(bare: Column, url: Column) -> Column:
    """Resolved http sources of frames."""
    sources = F.filter(F.transform(open_tags(bare, "iframe"), lambda t: attr(t, "src")), lambda s: s != "")
    placed = let(U.base_of(url), lambda base: F.transform(sources, lambda s: U.resolve_on(s, base)))
    return F.array_distinct(F.filter(placed, lambda s: s.rlike(r"(?i)^https?://")))


def hash_routes(html: Column, bare: Column, url: Column) -> Column:
    """Hash links that look like routes, then quoted routes of inline scripts."""
    hrefs = F.filter(F.transform(open_tags(bare, "a"), lambda t: attr(t, "href")),
                     lambda h: h.rlike(r"^#!?/"))
    inline = F.filter(blocks(F.regexp_replace(html, r"(?is)<!--.*?-->", ""), "script"),
                      lambda b: ~has_attr(head_tag(b), "src"))
    quoted = F.flatten(F.transform(inline, lambda b: F.regexp_extract_all(
        b, F.lit(r"""(?i)['"](/[a-z][a-z0-9-/]*)['"]"""), 1)))
    return let(U.base_of(url), lambda base: F.array_distinct(F.concat(
        F.transform(hrefs, lambda h: F.concat(base["origin"], base["path"], h)),
        F.transform(F.filter(quoted, lambda r: F.length(r) < 100), lambda r: F.concat(base["origin"], r)))))


def attr_routes(bare: Column, url: Column) -> Column:
    """Routes named by element attributes: array<struct<url, found_by, text>>."""
    def opening(names: str, hint: str) -> Column:
        """Elements with one of the attributes, and the text right after their start tag."""
        found = F.regexp_extract_all(bare, F.lit(rf"(?is)<[a-z][a-z0-9-]*(?=\s[^>]*(?:{names})){ATTRS}>[^<]*+"), 0)
        there = F.when(F.contains(bare, F.lit(hint)), found).otherwise(F.array().cast("array<string>"))
        return F.transform(there, lambda b: F.struct(
            head_tag(b).alias("tag"), F.substring(text_of(inner(b)), 1, 100).alias("text")))

    def found(href: Column, by: str, text: Column) -> Column:
        return F.struct(href.alias("href"), F.lit(by).alias("found_by"), text.alias("text"))

    def named(elements: Column) -> Column:
        """Attribute by attribute, each in document order."""
        return F.concat(*[F.transform(elements, lambda e: found(attr(e["tag"], name), "data-attr", e["text"]))
                          for name in ROUTE_ATTRIBUTES])

    def linked(elements: Column) -> Column:
        roles = F.filter(elements, lambda e: attr(e["tag"], "role") == "link")
        return F.flatten(F.transform(roles, lambda e: F.transform(
            F.regexp_extract_all(e["tag"], F.lit(r"""(?is)\s[^\s"'>=/]+\s*=\s*["']?((?:/|http)[^"'\s>]*)"""), 1),
            lambda v: found(v, "aria", e["text"]))))

    hashed = F.filter(F.transform(anchors(bare), lambda a: found(
        F.concat(F.lit("/"), attr(a.tag, "href")), "hash", F.substring(a.text, 1, 100))),
        lambda r: r.href.rlike(r"^/#!?/"))

    every = F.filter(F.concat(let(opening("|".join(ROUTE_ATTRIBUTES), "data-"), named),
                              linked(opening("role", "role")), hashed), lambda r: r.href != "")

    def placed(base: Column) -> Column:
        rows = F.transform(every, lambda r: F.struct(
            U.resolve_on(r.href, base).alias("url"), r.found_by.alias("found_by"), r.text.alias("text")))
        return F.filter(rows, lambda r: F.startswith(r.url, F.lit("http")))

    def first_of_each(rows: Column) -> Column:
        return let(F.transform(rows, lambda r: r.url), lambda seen: F.filter(
            rows, lambda r, i: F.array_position(seen, r.url) == i + 1))

    return let(let(U.base_of(url), placed), first_of_each)


def _class_box(bare: Column, word: str) -> Column:
    """Content of the first element whose class holds ``word``."""
    return F.when(F.contains(bare, F.lit(word)), F.regexp_extract(
        bare, rf"""(?is)<([a-z][a-z0-9]*)(?=\s)[^>]*\sclass\s*=\s*["'][^"'>]*{word}[^"'>]*["'][^>]*>(.*?)</\1\s*>""", 2)).otherwise(F.lit(""))


def pagination(bare: Column, url: Column) -> Column:
    """struct<next_url, prev_url, current_page> from ordered candidates."""
    def anchor_in(box: Column, at: int) -> Column:
        hrefs = F.filter(F.transform(open_tags(box, "a"), lambda t: attr(t, "href")), lambda h: h != "")
        return F.try_element_at(hrefs, F.lit(at))

    def candidates(p: Column) -> Column:
        def rel(name: str) -> Column:
            return first_where(p["tags"], lambda x: x["rel"] == name)["href"]

        def labelled(word: str) -> Column:
            return first_where(p["tags"], lambda x: F.contains(x["label"], F.lit(word)))["href"]

        active = F.regexp_extract(
            p["pages"], r"""(?is)<[a-z][^>]*(?:class\s*=\s*["'](?:[^"']*\s)?active(?:\s[^"']*)?["']|aria-current\s*=\s*["']page["'])[^>]*>\s*(\d+)""", 1)

        def ladder(name: str, at: int) -> Column:
            return F.coalesce(first_where(p["links"], lambda x: x["rel"] == name)["href"], rel(name),
                              anchor_in(p[name], 1), anchor_in(p["pages"], at), labelled(name))

        return let(U.base_of(url), lambda base: F.struct(
            U.resolve_on(ladder("next", -1), base).alias("next_url"),
            U.resolve_on(ladder("prev", 1), base).alias("prev_url"), or_null(active).cast("int").alias("current_page")))

    def described(bare: Column, name: str) -> Column:
        rows = F.transform(open_tags(bare, name), lambda t: F.struct(
            F.lower(attr(t, "rel")).alias("rel"), attr(t, "href").alias("href"),
            F.lower(attr(t, "aria-label")).alias("label")))
        return F.filter(rows, lambda x: x["href"] != "")

    return let_all({
        "tags": described(bare, "a"), "links": described(bare, "link"), "pages": _class_box(bare, "pagination"),
        "next": _class_box(bare, "next"), "prev": _class_box(bare, "prev")}, candidates)
