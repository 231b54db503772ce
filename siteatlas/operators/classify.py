"""Page classification: what kind of page was captured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteatlas.functions import html as H
from siteatlas.functions import text as X
from siteatlas.functions import urls as U
from siteatlas.functions.bind import let, let_all

# ---- fixed values -----------------------------------------------------------
OAUTH_HREFS = ["accounts.google.com", "login.microsoftonline.com", "auth0.com", "login.okta.com",
               "github.com/login", "appleid.apple.com", "login.salesforce.com"]
OAUTH_CLASSES = ["google-sign", "google-login", "google-auth", "oauth", "sso", "social-login"]
OAUTH_ATTRIBUTES = ["data-provider", "data-auth-provider"]
OAUTH_TEXTS = [
    ("sign in with google", "google"), ("continue with google", "google"), ("login with google", "google"),
    ("sign in with microsoft", "microsoft"), ("continue with microsoft", "microsoft"),
    ("sign in with github", "github"), ("continue with github", "github"),
    ("sign in with sso", "sso"), ("login with sso", "sso"), ("single sign-on", None),
    ("sign in with apple", "apple"), ("continue with apple", "apple"),
]
PROVIDER_HREFS = [("accounts.google.com", "google"), ("login.microsoftonline.com", "microsoft"),
                  ("github.com/login", "github")]
CAPTCHA_FRAMES = ["recaptcha", "captcha", "hcaptcha", "challenge"]
BLOCKED_TEXTS = ["access denied", "forbidden", "unauthorized"]
# (kind of selector, name, label), tried in this order.
CHALLENGE_SELECTORS = [
    ("id", "cf-challenge-running", "cloudflare"), ("id", "challenge-running", "cloudflare"),
    ("id", "challenge-form", "cloudflare"), ("iframe", "challenges.cloudflare.com", "cloudflare"),
    ("class", "cf-browser-verification", "cloudflare"), ("id", "ddos-guard", "ddos-guard"),
    ("class", "ddos", "ddos-guard"), ("class", "sucuri", "sucuri"), ("id", "akamai-challenge", "akamai"),
]
CHALLENGE_TEXTS = [("checking your browser", "cloudflare"), ("just a moment", "cloudflare"),
                   ("verify you are human", "cloudflare"), ("please wait while we verify", "generic"),
                   ("ddos protection by", "ddos-guard"), ("access denied - sucuri", "sucuri")]
SIGNED_IN_CLASSES = ["logout", "sign-out", "signout", "user-menu", "user-avatar", "profile-menu",
                     "account-menu"]
SIGNED_IN_HREFS = ["logout", "signout", "sign-out"]
SIGNED_IN_TEXTS = ["log out", "sign out"]
SIGNED_IN_TEST_IDS = ["user", "avatar"]
AUDIENCES = [(["admin", "manage"], "Administrators"), (["dashboard", "analytics"], "Managers"),
             (["settings", "profile"], "All users"), (["register", "sign up"], "New users")]
# -----------------------------------------------------------------------------


def _class_holds(html: Column, words: list[str]) -> Column:
    return html.rlike(rf"""(?s)<[a-zA-Z][^>]*\sclass\s*=\s*(?:"[^"]*({"|".join(words)})|'[^']*({"|".join(words)}))""")


def _attr_holds(html: Column, tag: str, name: str, words: list[str]) -> Column:
    return html.rlike(rf"""(?s)<{tag}[^>]*\s{name}\s*=\s*(?:"[^"]*({"|".join(words)})|'[^']*({"|".join(words)}))""")


def _has_id(html: Column, name: str) -> Column:
    return html.rlike(rf"""(?s)<[a-zA-Z][^>]*\sid\s*=\s*["']?{name}["'\s>]""")


def _input(html: Column, test) -> Column:
    return F.exists(H.open_tags(html, "input"), test)


def _clickables(bare: Column) -> Column:
    """Anchors and buttons in document order, as blocks."""
    found = F.regexp_extract_all(bare, F.lit(
        rf"(?is)<(?:(a|button)(?=[\s>]){H.ATTRS}>.*?(?:</\1\s*>|\z)"
        rf"|([a-z][a-z0-9-]*)(?=\s[^>]*role\s*=\s*[\"']?button){H.ATTRS}>.*?(?:</\2\s*>|\z))"), 0)
    return found


def oauth(bare: Column) -> Column:
    """struct<detected, providers> of third-party sign-in; HTML without scripts."""
    marked = (_attr_holds(bare, "a", "href", [h.replace(".", r"\.") for h in OAUTH_HREFS])
              | _class_holds(bare, OAUTH_CLASSES)
              | bare.rlike(rf"(?is)<[a-z][^>]*\s({'|'.join(OAUTH_ATTRIBUTES)})(?=[\s=/>])"))

    def named(e: Column) -> Column:
        hits = [F.when(F.contains(e["text"], F.lit(words)), F.lit(provider or "")) for words, provider in OAUTH_TEXTS]
        via = F.lit(None).cast("string")
        for domain, provider in reversed(PROVIDER_HREFS):
            via = F.when(F.contains(e["href"], F.lit(domain)), F.lit(provider)).otherwise(via)
        return F.array_compact(F.array(*hits, via))

    def summed(seen: Column) -> Column:
        said = F.flatten(F.transform(seen, named))
        spoken = F.exists(seen, lambda e: U.contains_any(e["text"], [words for words, _ in OAUTH_TEXTS]))
        return F.struct((marked | spoken).alias("detected"),
                        F.array_distinct(F.filter(said, lambda p: p != "")).alias("providers"))

    seen = F.transform(_clickables(bare), lambda b: F.struct(
        F.lower(H.text_of(b)).alias("text"), F.lower(H.attr(H.head_tag(b), "href")).alias("href")))
    return let(seen, summed)


def obstacle(html: Column, url: Column) -> Column:
    """struct<type, message, providers>: the first thing that stands in the way; NULL type if none."""
    def found(p: Column) -> Column:
        bare, text, sso = p["bare"], p["text"], p["sso"]
        secret = _input(bare, lambda t: F.lower(H.attr(t, "type")) == "password")
        who = _input(bare, lambda t: (F.lower(H.attr(t, "type")) == "email") | H.attr(t, "name").isin("email", "username"))
        asks = U.contains_any(text, ["sign in", "log in", "enter your password"])
        hrefs = F.transform(H.open_tags(bare, "a"), lambda t: H.attr(t, "href"))
        inner = F.filter(hrefs, lambda h: F.startswith(h, F.lit("/")) & ~U.contains_any(h, ["login", "auth", "signin"]))
        captcha = (_class_holds(bare, ["captcha"]) | _attr_holds(bare, "iframe", "src", CAPTCHA_FRAMES))
        blocked = (F.length(text) < 2000) & U.contains_any(text, BLOCKED_TEXTS)
        return (F.when(sso["detected"], "oauth")
                .when((secret & who) | (secret & asks) | (U.is_login(url) & (F.size(inner) < 5)), "login")
                .when(captcha, "captcha").when(blocked, "blocked"))

    def told(kind: Column, providers: Column) -> Column:
        listed = F.array_join(providers, ", ")
        message = (F.when(kind == "oauth", F.concat(
            F.lit("OAuth/SSO login detected"),
            F.when(listed != "", F.concat(F.lit(" ("), listed, F.lit(")"))).otherwise(F.lit("")),
            F.lit(". Please sign in using the browser window.")))
            .when(kind == "login", F.lit("Login page detected. Please log in."))
            .when(kind == "captcha", F.lit("CAPTCHA detected."))
            .when(kind == "blocked", F.lit("Access denied. Authentication may be required.")))
        return F.struct(kind.alias("type"), message.alias("message"),
                        F.when((kind == "oauth") & (listed != ""), providers).alias("providers"))

    return let(H.drop_scripts(html), lambda bare: let_all(
        {"bare": bare, "text": H.body_text(html), "sso": oauth(bare)},
        lambda p: let(found(p), lambda kind: told(kind, p["sso"]["providers"]))))


def challenge(html: Column) -> Column:
    """Which protection page was captured instead of content; NULL if none."""
    return let(H.drop_scripts(html), lambda bare: let(
        F.substring(H.body_text(html), 1, 1000), lambda opening: _challenge_kind(bare, opening)))


def _challenge_kind(bare: Column, opening: Column) -> Column:
    """Selectors in order, then phrases at the start of the page."""
    matches = {"id": lambda name: _has_id(bare, name), "class": lambda name: _class_holds(bare, [name]),
               "iframe": lambda name: _attr_holds(bare, "iframe", "src", [name.replace(".", r"\.")])}
    kind = F
    for how, name, label in CHALLENGE_SELECTORS:
        kind = kind.when(matches[how](name), F.lit(label))
    for phrase, label in CHALLENGE_TEXTS:
        kind = kind.when(F.contains(opening, F.lit(phrase)), F.lit(label))
    return kind


def session_state(html: Column, final_url: Column, status: Column, known_logins: tuple[str, ...] = ()) -> Column:
    """valid, http_401, http_403 or login_redirect."""
    bare = H.drop_scripts(html)
    form = (_input(bare, lambda t: F.lower(H.attr(t, "type")) == "password")
            & _input(bare, lambda t: (F.lower(H.attr(t, "type")) == "email") | H.attr(t, "name").isin("email", "username"))
            & U.contains_any(H.body_text(html), ["sign in", "log in", "login"]))
    return (F.when(status == 401, "http_401").when(status == 403, "http_403")
            .when(U.is_login(final_url, True, known_logins) | form, "login_redirect").otherwise("valid"))


def logged_in(html: Column) -> Column:
    """Markers of a signed-in user are present."""
    bare = H.drop_scripts(html)
    presses = F.transform(H.blocks(bare, "button"), lambda b: F.lower(H.text_of(b)))
    return (_class_holds(bare, SIGNED_IN_CLASSES) | _attr_holds(bare, "a", "href", SIGNED_IN_HREFS)
            | F.exists(presses, lambda t: U.contains_any(t, SIGNED_IN_TEXTS))
            | _attr_holds(bare, "[a-zA-Z]", "data-testid", SIGNED_IN_TEST_IDS))


def target_users(html: Column) -> Column:
    found = let(H.body_text(html, with_scripts=True), lambda text: F.array_compact(F.array(
        *[F.when(U.contains_any(text, words), F.lit(name)) for words, name in AUDIENCES])))
    return let(found, lambda names: F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("General users"))))


def structural_analysis(html: Column, page_title: Column) -> Column:
    """struct<page_purpose, target_users, elements, steps, common_issues>."""
    none = F.array().cast("array<string>")

    def analysed(p: Column) -> Column:
        title = p["title"]
        going = F.concat(F.lit("Navigate to "), title)
        purpose = (F.when(p["h1"] != "", F.concat(title, F.lit(" - "), p["h1"]))
                   .when(p["about"] != "", F.concat(title, F.lit(": "), p["about"]))
                   .otherwise(F.coalesce(H.or_null(title), F.lit("Application page"))))
        steps = let(F.concat(_heading_steps(p["bare"], going), _form_steps(p["form"], p["labels"])), lambda s: F.when(
            F.size(s) > 1, s).otherwise(F.array(going, F.lit("Review page content"))))
        return F.struct(
            purpose.alias("page_purpose"), target_users(html).alias("target_users"),
            _described_elements(p["bare"], p["labels"]).alias("elements"), steps.alias("steps"),
            _issues(p["bare"]).alias("common_issues"))

    unread = F.struct(
        F.coalesce(H.or_null(page_title), F.lit("Unknown page")).alias("page_purpose"), none.alias("target_users"),
        F.array().cast("array<struct<selector: string, description: string, user_action: string>>").alias("elements"),
        none.alias("steps"), none.alias("common_issues"))
    read = let(H.drop_scripts(html), lambda bare: let_all({
        "bare": bare, "title": F.coalesce(H.or_null(page_title), H.title(bare)),
        "h1": F.coalesce(F.try_element_at(H.headings(bare, "1", first=1, max_text=1 << 20), F.lit(1))["text"], F.lit("")),
        "about": F.coalesce(F.try_element_at(H.meta(bare), F.lit("description")), F.lit("")),
        "labels": H.labels(bare), "form": F.try_element_at(H.form_blocks(bare), F.lit(1))}, analysed))
    return F.when(F.coalesce(html, F.lit("")) == "", unread).otherwise(read)


def _described_elements(bare: Column, known: Column) -> Column:
    """Fields, then buttons, as selector, description and action; first 20."""
    def field(tag: Column) -> Column:
        name = F.coalesce(H.or_null(H.attr(tag, "name")), H.attr(tag, "id"))
        label = F.coalesce(H.label_for(known, tag), H.or_null(H.attr(tag, "placeholder")),
                           H.or_null(H.attr(tag, "aria-label")), name)

        def row(v: Column) -> Column:
            return F.when((v["label"] != "") & (v["type"] != "hidden"), F.struct(
                F.when(v["name"] != "", F.concat(F.lit('[name="'), v["name"], F.lit('"]')))
                .otherwise(H.tag_name(tag)).alias("selector"),
                F.concat(v["label"], F.lit(" ("), v["type"], F.lit(" field)")).alias("description"),
                F.when(v["type"] == "select", F.lit("Select an option")).otherwise(
                    F.concat(F.lit("Enter "), F.lower(v["label"]))).alias("user_action")))

        return let_all({"name": name, "type": H.control_type(tag), "label": label}, row)

    def press(text: Column) -> Column:
        return F.when(F.length(text) < 100, F.struct(
            F.lit("button").alias("selector"), F.concat(F.lit('"'), text, F.lit('" button')).alias("description"),
            F.concat(F.lit('Click "'), text, F.lit('"')).alias("user_action")))

    fields = F.transform(H.control_blocks(bare), lambda c: let(H.head_tag(c), field))
    presses = F.transform(H.button_blocks(bare, ("submit",)), lambda b: let(
        F.coalesce(H.or_null(H.button_text(b)), F.lit("Button")), press))
    return F.slice(F.array_compact(F.concat(fields, presses)), 1, 20)


def _heading_steps(bare: Column, going: Column) -> Column:
    heads = F.slice(F.regexp_extract_all(bare, F.lit(r"(?is)<h([1-3])\b[^>]*>.*?</h\1\s*>"), 0), 1, 5)
    named = let(heads, lambda found: F.when(F.size(found) > 0, F.concat(F.array(going), F.transform(
        F.filter(F.transform(found, lambda b: H.text_of(b)), lambda x: x != ""),
        lambda x: F.concat(F.lit('Review "'), x, F.lit('" section'))))))
    return F.coalesce(named, F.array().cast("array<string>"))


def _form_steps(form: Column, known: Column) -> Column:
    """Steps to fill in and submit the first form of a page."""
    def fill(tag: Column) -> Column:
        label = F.coalesce(H.label_for(known, tag), H.or_null(H.attr(tag, "placeholder")), H.attr(tag, "name"))
        secret = (H.tag_name(tag) == "input") & (F.lower(H.attr(tag, "type")) == "hidden")
        return let(label, lambda x: F.when((x != "") & ~secret, F.concat(F.lit('Fill in "'), x, F.lit('"'))))

    submits = F.filter(H.button_blocks(form, ("submit",), roles=False),
                       lambda b: F.lower(H.attr(H.head_tag(b), "type")) == "submit")
    press = let(submits, lambda found: F.when(F.size(found) > 0, F.array(F.concat(F.lit('Click "'), F.coalesce(
        H.or_null(X.trimmed(F.array_join(F.transform(found, lambda b: H.text_of(b)), ""))), F.lit("Submit")),
        F.lit('"')))).otherwise(F.array().cast("array<string>")))
    filled = F.array_compact(F.transform(H.control_blocks(form), lambda c: let(H.head_tag(c), fill)))
    return F.coalesce(F.when(form.isNotNull(), F.concat(filled, press)), F.array().cast("array<string>"))


def _issues(bare: Column) -> Column:
    def listed(tags: Column) -> Column:
        needed = F.size(F.filter(tags, lambda t: H.has_attr(t, "required")))

        def has_type(kind: str) -> Column:
            return F.exists(tags, lambda t: (H.tag_name(t) == "input") & (F.lower(H.attr(t, "type")) == kind))

        return F.array_compact(F.array(
            F.when(needed > 0, F.concat(needed.cast("string"), F.lit(" required field(s) must be filled"))),
            F.when(has_type("password"), F.lit("Password field present - ensure password meets requirements")),
            F.when(has_type("email"), F.lit("Email field requires valid email format"))))

    return let(H.open_tags(bare, "input|select|textarea"), listed)
