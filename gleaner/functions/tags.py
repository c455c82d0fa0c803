"""Tag sets of the block rules and of tolerant parsing."""

#: Elements whose subtree is left out; the text after them counts.
IGNORED = tuple(
    "applet area base basefont bdo button caption fieldset fram frameset iframe img input legend link menu meta noframes "
    "noscript object optgroup option param script select style textarea var xmp like like-box plusone svg math".split()
)
#: Elements whose start tag begins a block.
BLOCK_STARTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "table", "map")
#: Elements without an end tag.
VOID = tuple("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
#: Points that an element's tag adds to its score.
TAG_WEIGHTS = (
    dict.fromkeys(("div", "pre", "td", "blockquote"), 5)
    | dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -3)
    | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -5)
)
#: Words in a class or id that speak for or against an element.
GOOD_WORDS = "|".join(("article", "body", "content", "entry", "hentry", "main", "page", "pagination", "post", "text", "blog", "story"))
BAD_WORDS = "|".join(
    ("combx", "comment", "com-", "contact", "foot", "footer", "footnote", "masthead", "media", "meta", "outbrain", "promo")
    + ("related", "scroll", "shoutbox", "sidebar", "sponsor", "shopping", "tags", "tool", "widget")
)
#: Words looked for in the id and the class of a block.
CSS_WORDS = {
    "id": tuple("nav ss top content link title comment tools rating".split()),
    "class": tuple(
        "menu widget nav share facebook cat top content item twitter button title header ss post comment meta alt time depth "
        "thread author tools reply url avatar".split()
    ),
}
#: Start tags before which an open paragraph or head ends.
BLOCK_LEVEL = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: Other elements that a start tag ends when they are open and innermost.
ENDS = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th", "caption", "colgroup")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "tbody": frozenset(("thead", "tbody", "tr", "td", "th")),
    "option": frozenset(("option",)),
    "a": frozenset(("a",)),
    "body": frozenset(("head",)),
}
#: An end tag doesn't reach beyond an open element of a higher rank.
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
