"""Lead images, comic panels and galleries: a table of pages, each with the picture that should win."""

import pytest

from feedloom.functions import images
from feedloom.functions.tree import parsed

BASE = "https://site.org/2024/05/post/"
P = "https://cdn.org/p"  # a plain picture


def img(src="/a.jpg", **more):
    own = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in more.items() if k != "css")
    return f'<img src="{src}"{own}' + (f' class="{more["css"]}"' if "css" in more else "") + ">"


@pytest.mark.parametrize("page, want", [
    (img(f"{P}1.jpg") + img(f"{P}2.jpg"), f"{P}1.jpg"), (img(f"{P}1.jpg") + img(f"{P}2.jpg", css="post-hero-image"), f"{P}2.jpg"), (img(f"{P}1.jpg") + img(f"{P}2.jpg", alt="x" * 40), f"{P}1.jpg"),
    (img(f"{P}1.jpg") + img(f"{P}2.jpg", alt="x" * 40, srcset=f"{P}3.jpg 800w, {P}4.jpg 1600w"), f"{P}4.jpg"), (img(f"{P}1.jpg") + img(f"{P}-cover.jpg"), f"{P}-cover.jpg"), (img(f"{P}1.jpg") + img(f"{P}2.jpg", fetchpriority="high"), f"{P}2.jpg"),
    # by their tags
    (img(f"{P}1.jpg", width=1, height=1) + img(f"{P}2.jpg"), f"{P}2.jpg"), (img(f"{P}1.jpg", width=150) + img(f"{P}2.jpg", width=200, height=100), f"{P}2.jpg"), (img(f"{P}1.jpg", width=300, height=300) + img(f"{P}2.jpg"), f"{P}2.jpg"), (img(f"{P}1.jpg", width=401, height=401), f"{P}1.jpg"),
    (img(f"{P}1.jpg", width=300, height=300, css="wp-post-image"), f"{P}1.jpg"), (img(f"{P}1.jpg", height="60%") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img(f"{P}1.jpg", css="wp-smiley") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img(f"{P}1.jpg", css="avatar") + img(f"{P}2.jpg"), f"{P}2.jpg"),
    (img(f"{P}1.jpg", alt="Site logo") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img(f"{P}1.jpg", alt="The logo", width=640, height=480), f"{P}1.jpg"), (img(f"{P}1.jpg", alt="Advertisement") + img(f"{P}2.jpg"), f"{P}2.jpg"),
    ('<img src="data:image/gif;base64,R0" data-src="https://cdn.org/x.jpg">', None), ('<img src="data:image/gif;base64,R0" data-src="https://cdn.org/x.jpg" width="700">', "https://cdn.org/x.jpg"), (img(f"{P}1.jpg?resize=1900,470") + img(f"{P}2.jpg"), f"{P}2.jpg"),
    # by their addresses
    (img("https://cdn.org/pixel.gif") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img("https://s.w.org/images/core/emoji/1.png") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img("https://secure.gravatar.com/x.jpg") + img(f"{P}2.jpg"), f"{P}2.jpg"), (img("${item.url}") + img("{{url}}"), None),
    (img("https://cdn.org/site-logo.png"), None), (img("https://cdn.org/logo-750x476.png"), "https://cdn.org/logo-750x476.png"), (img("https://cdn.org/logo-600x100.png"), None), (img("product-logo.png"), f"{BASE}product-logo.png"), (img("https://cdn.org/logo.png?fit=800%2C600"), "https://cdn.org/logo.png?fit=800%2C600"),
    (img("https://cdn.org/placeholder.png"), None), (img("https://cdn.org/fallback.webp", width=640, height=360), "https://cdn.org/fallback.webp"), (img("https://cdn.org/blank.jpg", width=200, height=200), None), (img("https://cdn.org/ads/x.jpg") + img("https://cdn.org/Cert-ad1.png"), None),
    (img("https://cdn.org/x-150x150.jpg") + img("https://cdn.org/y-1200x675.jpg"), "https://cdn.org/y-1200x675.jpg"), (img("https://cdn.org/x-16x9-1200x675.jpg"), "https://cdn.org/x-16x9-1200x675.jpg"), (img("https://cdn.org/x.jpg?w=120"), None), (img("https://cdn.org/thumbs/x-150x90.jpg"), "https://cdn.org/thumbs/x-150x90.jpg"),
    (img("https://cdn.org/f/w_90,h_90/x.jpg") + img("https://cdn.org/a,w_90,b/x.jpg"), None), (img("https://cdn.org/1ad8-4c/ad87f3c2-1b2c-4d5e-8f90-aabbccddeeff.jpg"), "https://cdn.org/1ad8-4c/ad87f3c2-1b2c-4d5e-8f90-aabbccddeeff.jpg"), (img("https://cdn.org/drawing.svg"), None), (img("//cdn.org/a.jpg"), "https://cdn.org/a.jpg"),
    # by what they stand in, however deep
    (f'<div class="related-posts"><div><div>{img(f"{P}1.jpg", css="hero-image")}</div></div></div>{img(f"{P}2.jpg")}', f"{P}2.jpg"), (f'<nav>{img(f"{P}1.jpg")}</nav><header class="site-header"><a>{img(f"{P}3.jpg")}</a></header>{img(f"{P}2.jpg")}', f"{P}2.jpg"),
    (f'<div class="author-bio"><p>{img(f"{P}1.jpg")}</p></div>{img(f"{P}2.jpg")}', f"{P}2.jpg"), (f'<div class="author-bio"><p>x</p></div><figure>{img(f"{P}2.jpg")}</figure>', f"{P}2.jpg"), (f'<nav>{img(f"{P}1.jpg", css="wp-post-image")}</nav>', f"{P}1.jpg"),
    (f'<a href="https://www.facebook.com/us">{img(f"{P}1.jpg")}</a>{img(f"{P}2.jpg")}', f"{P}2.jpg"), (f'<picture><source type="image/webp" srcset="{P}s.webp 400w, {P}l.webp 900w"><source srcset="{P}o.jpg">{img(f"{P}1.jpg")}</picture>', f"{P}l.webp"), ("", None), ("<p>none</p>", None),
])
def test_lead_images(page, want):
    assert images.best(parsed(page), BASE)[0] == want


def test_scores_add_up():
    page = img(f"{P}-hero.jpg", css="hero-image featured", alt="y" * 20, srcset=f"{P}-hero.jpg 2x", fetchpriority="high", data_component_name="Image")
    assert images.best(parsed(page), BASE) == (f"{P}-hero.jpg", 120 + 40 + 30 + 40 + 20 + 10 + 5 + 15 + 10, "y" * 20)


@pytest.mark.parametrize("page, want", [
    (f'<div id="comic">{img("/strips/1.png")}</div>{img(f"{P}2.jpg", css="hero-image")}', "https://site.org/strips/1.png"), (f'{img(f"{P}2.jpg")}<img id="cc-comic" src="/c.png">', "https://site.org/c.png"), (f'<div class="webcomic-nav">{img(f"{P}1.jpg")}</div>', None),
    (f'<div class="related"><div class="comic">{img("/r.png")}</div></div><div class="comic-body"><p>{img("/c.png")}</p></div>', "https://site.org/c.png"), (img("/c.png", css="comic_image"), "https://site.org/c.png"), (img("/c.png"), None), (f'<div class="comic-links">{img("/c.png")}</div>', None),
])
def test_comic_panels(page, want):
    assert images.panel(parsed(page), BASE) == want


def test_galleries():
    page = "".join([img("/x/one.jpg"), img("/2024/05/post/one.jpg"), img("two.jpg"), img("/y/two.jpg"), img("three.jpg?a"), img("three.jpg?a"), img("/logo.png"), f'<aside>{img("/z.jpg")}</aside>'])
    assert images.collected(parsed(page), BASE) == [f"{BASE}one.jpg", f"{BASE}two.jpg", f"{BASE}three.jpg?a"]
    assert images.collected(parsed(page), BASE, 2) == [f"{BASE}one.jpg", f"{BASE}two.jpg"] and images.collected(parsed(""), "") == []
    assert images.ranked("a.jpg 1x, b,c.jpg 2x, d.jpg 300w, , e.jpg") == ["b,c.jpg", "a.jpg", "e.jpg", "d.jpg"]
