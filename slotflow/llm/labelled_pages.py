"""The small labelled table that trains the main-text tree: pages, and the texts of their main blocks."""

from __future__ import annotations

_LONG = (
    "The harbour office moved its evening ferries to the northern quay last week, because the old pier needs new planks before the winter storms arrive.",
    "Passengers will find signs at the station, and staff will wait at the corner for anyone who has never walked the longer way along the water.",
    "Work should end in four weeks, the office said, though nobody on the quay believed it when asked on a wet morning with gulls overhead.",
    "Until then the first boat leaves ten minutes early, the last one waits for the late train, and bicycles travel free on every crossing.",
)
_SHORT = ("It rained.", "Nobody minded much.", "A boat came in at noon with fish.", "See the quay.")
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "Boats", "Weather", "Maps", "Contact"))
_MENU = f"<nav><ul>{_LINKS}</ul></nav>"
_ADVERT = '<div class="ad">New planks for every pier, ask at the quay today.</div>'
_FOOT = "<footer>&copy; harbour.example &middot; All rights reserved by the harbour office.</footer>"
_SAID = '<section class="comments"><h2>Comments</h2><div>I took the early boat and it was late, as it always is in rain, so bring a book.</div><div>Same here.</div></section>'


def _paragraphs(texts: tuple[str, ...]) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


LABELLED: list[tuple[str, list[str]]] = [
    (
        f"<html><head><title>Ferries</title></head><body>{_MENU}{_ADVERT}<article><h1>Ferries move north</h1>{_paragraphs(_LONG)}{_paragraphs(_SHORT)}</article>{_FOOT}</body></html>",
        ["Ferries move north", *_LONG, *_SHORT],
    ),
    (
        f'<body><header><h1>Harbour News</h1><p>Tides and boats since the old days of the pier</p></header>{_MENU}<main><h2>A short note</h2>{_paragraphs(_SHORT)}</main><aside><h3>Most read</h3><ul>{_LINKS}</ul><p>Get the tides by letter each morning before breakfast.</p></aside>{_FOOT}</body>',
        ["A short note", *_SHORT],
    ),
    (
        f'<body><div id="menu"><a href="/">Home</a> <a href="/b">Boats</a> <a href="/w">Weather</a></div><div class="cookie-notice">We use cookies to count visits, and to remember which quay you like. <button>Fine</button></div><div id="content"><h1>Planks</h1>{_paragraphs(_LONG[:2])}</div>{_SAID}<div class="sidebar">{_ADVERT}<p>Boats for sale, nearly dry.</p></div>{_FOOT}</body>',
        ["Planks", *_LONG[:2]],
    ),
    (
        f'<body><table><tr><td><a href="/a">Home</a> <a href="/b">Tides</a> <a href="/c">Boats</a></td></tr></table><div>{_paragraphs(_LONG)}</div><div><a href="/x">Earlier</a> <a href="/y">Later</a></div><div>Harbour office, quay one</div></body>',
        list(_LONG),
    ),
    (
        f'<body><article>{_paragraphs(_LONG[1:3])}<form><label>Your name</label><input name="n"><p>Tell us what you think of the new timetable in a few words.</p></form><div class="share">Share this with a friend</div><p>{_SHORT[2]}</p><div class="ad">{_LONG[3]}</div></article>{_SAID}<div class="related"><h3>Related</h3><ul>{_LINKS}</ul></div></body>',
        [*_LONG[1:3], _SHORT[2]],
    ),
    (
        f'<body>{_MENU}<div class="newsletter">{_LONG[0]}</div><div class="post"><h2>Fish at noon</h2><p>{_SHORT[2]}</p><p>Read <a href="/more">more about the fish that came in at noon</a>.</p><p>{_SHORT[0]}</p></div><div id="footer">{_LONG[1]}</div></body>',
        ["Fish at noon", _SHORT[2], "Read more about the fish that came in at noon.", _SHORT[0]],
    ),
    (
        f"<body><p>{_LONG[0]}</p><p>{_LONG[2]}</p><ul>{_LINKS}</ul><p>{_LONG[3]}</p><p>Harbour office</p></body>",
        [_LONG[0], _LONG[2], _LONG[3]],
    ),
    (f"<body>{_MENU}<article><h1>Rain</h1>{_paragraphs(_SHORT)}</article></body>", ["Rain", *_SHORT]),
    (f"<article><p>{_SHORT[1]}</p><p>{_LONG[1]}</p><p>{_SHORT[0]}</p></article>", [_SHORT[1], _LONG[1], _SHORT[0]]),
    (f"<body><main><p>{_SHORT[3]}</p></main></body>", [_SHORT[3]]),
    (f'<body><div class="entry"><p>{_LONG[2]}</p><p>{_SHORT[1]}</p></div></body>', [_LONG[2], _SHORT[1]]),
    (f"<p>{_LONG[3]}</p>", [_LONG[3]]),
    # Wrappers named after a layout, and names that only look like what stands around a text.
    (
        f'<body class="has-sidebar"><div class="layout with-sidebar"><div class="column"><h1>Planks</h1>{_paragraphs(_LONG[:3])}</div><div class="sidebar-right"><p>{_SHORT[0]}</p></div></div>{_FOOT}</body>',
        ["Planks", *_LONG[:3]],
    ),
    (f'<body><div class="social-history">{_paragraphs(_LONG[1:])}</div></body>', list(_LONG[1:])),
    (f'<form id="page"><article><h2>Tides</h2>{_paragraphs(_LONG[:2])}</article><footer>{_SHORT[3]}</footer></form>', ["Tides", *_LONG[:2]]),
    # An article's own head, adverts as paragraphs, things to share between its points.
    (
        f'<body>{_MENU}<article class="post"><header class="entry-header"><h1>Rain at the pier</h1></header><p>{_LONG[0]}</p><p class="advert">{_LONG[2]}</p><ul><li>First the boats.<li class="share">Share it<li>Then the train.</ul><p>{_SHORT[1]}</p></article></body>',
        ["Rain at the pier", _LONG[0], "First the boats.", "Then the train.", _SHORT[1]],
    ),
    # Short pages without any names, and texts without tags.
    ("<p>One boat.</p><p>Another boat.</p>", ["One boat.", "Another boat."]),
    ("<body><h1>Fog</h1><p>No boats today.</p></body>", ["Fog", "No boats today."]),
    ("A line without any tag", ["A line without any tag"]),
    (f"<div><div><h2>Gulls</h2><div>{_SHORT[2]}</div><div>{_SHORT[1]}</div></div></div>", ["Gulls", _SHORT[2], _SHORT[1]]),
    # Short article, long comments; links inside an article, and lists of links outside of one.
    (
        f'<body><article><h1>Fish</h1><p>{_SHORT[2]}</p></article><div id="comments"><h3>Two readers</h3><ol class="comment-list"><li><p>{_LONG[0]}</p><li><p>{_LONG[1]}</p></ol></div></body>',
        ["Fish", _SHORT[2]],
    ),
    (
        f'<body><div><a href="/">Home</a> | <a href="/a">About the harbour</a></div><article><p>{_LONG[3]}</p><p><a href="/t">The timetable of all boats</a></p><ul><li><a href="/x">Planks</a>, and where to buy them</li></ul></article><div><a href="/y">Older</a></div></body>',
        [_LONG[3], "The timetable of all boats", "Planks, and where to buy them"],
    ),
    (
        f'<body><div class="top"><a href="/">Harbour</a></div><div class="story"><h1>Winter</h1><p>{_LONG[1]}</p><h2>Spring</h2><p>{_LONG[2]}</p><table><tr><th>Boat<th>Time<tr><td>Early<td>Six</table></div><div class="related-links"><a href="/1">Summer</a></div></body>',
        ["Winter", _LONG[1], "Spring", _LONG[2], "Boat", "Time", "Early", "Six"],
    ),
    (
        f'<body><div role="banner">Harbour News</div><div role="main"><p>{_LONG[0]}</p></div><div role="complementary"><p>{_LONG[2]}</p></div><div role="contentinfo">{_SHORT[0]}</div></body>',
        [_LONG[0]],
    ),
    # Articles that end in short blocks, in links or in the middle of a list.
    (f"<article><h1>List</h1><p>{_LONG[0]}</p><ol><li>Ropes<li>Two lamps<li>Bread</ol></article>", ["List", _LONG[0], "Ropes", "Two lamps", "Bread"]),
    (f'<body>{_MENU}<article><p>{_LONG[1]}</p><p>{_SHORT[0]}</p><p><a href="/q">Quay</a></p></article><p><a href="/z">Next</a></p></body>', [_LONG[1], _SHORT[0], "Quay"]),
    (f'<main><p>{_LONG[2]}</p><table><tr><td>Low<td>High</table></main><div class="ad">{_SHORT[0]}</div>', [_LONG[2], "Low", "High"]),
    (f'<div class="content"><p>{_LONG[3]}</p><blockquote>{_SHORT[1]}</blockquote></div><div>{_SHORT[0]}</div>', [_LONG[3], _SHORT[1]]),
    (f'<article><p>{_LONG[0]}</p><p>{_LONG[1]}</p><h3>Ends</h3></article><div><a href="/b">Back</a></div>', [_LONG[0], _LONG[1], "Ends"]),
    (f'<body><div id="nav"><a href="/">Home</a> of the boats</div><article><p>{_SHORT[2]}</p><p><a href="/k">Knots</a> and ropes</p></article></body>', [_SHORT[2], "Knots and ropes"]),
]
