"""Hand-written pages and selector sets for the unit tests: a hardware shop."""

SELECTORS_A = {
    "name": "h1.item-head b",
    "brand": ".maker, [data-maker]",
    "sku": "span.code",
    "price": "aside .cost",
    "description": ".sheet\\.text .body, .fallback-text, .body",
    "pack_size": ".per-unit",
    "availability": "link[rel='stock'], [itemprop='availability']",
    "images": ".photos img, .photos.wide img",
    "specifications_rows": "table.facts tr",
    "breadcrumbs": "ol.trail li",
}
SELECTORS_B = SELECTORS_A | {"sku": "form[data-sku], span.code", "description": ".body, .fallback-text"}

TRAIL = '<ol class="trail"><li>Home<li>Workshop<li>Clamps</ol>'
PAGE_A = f"""<html><head><title>Clamps and more</title></head>
<body>{TRAIL}<h1 class="item-head">Buy <b>Bar clamp 300 mm</b></h1>
<div class="per-unit"> 2 pieces </div><span class="maker"></span><span data-maker>Torvald</span> <span class="code">
 BC-0300 </span>
<aside>only <i class="cost">$1,018.50</i></aside>
<div class="sheet.text"><div class="body">Cast iron jaws.<br>Opens with one hand.</div></div>
<link rel="stock" href="urn:x:BackOrder">
<div class="photos wide"><img src="/img/front.webp"><img data-src="side.webp" src=""><img src="/img/front.webp"></div>
<table class="facts"><tr><td>Jaw<td>80 mm<tr><td>Jaw<td>85 mm</tr><tr><th>Steel</th><td>C45</td></tr></table></body></html>"""


def page_b(extra: str = "") -> str:
    return f"""<body>{TRAIL}<h1 class="item-head"><b>Spring clamp</b></h1><p class="maker">Torvald<form data-sku="SC-7" action="/buy">
<button>Buy</button></form>{extra}<aside><u class="cost">$3.25</u></aside><section class="body">Nylon pads, red grip. 12/box.</section>
<i itemprop="availability" href="https://schema.org/InStock"></i><div class="photos"><img src="https://cdn.example.com/sc7.png"></div>"""


ONE_SPEC = "<table class=facts><tr><td>material<td>steel</table>"
