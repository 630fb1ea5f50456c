import pytest

from lullwatch.llm import pages as P

TEXT = "<h1>Title</h1><p>The first paragraph of the text.</p><p>The second one.</p>"
PLAIN = "Title\nThe first paragraph of the text.\nThe second one."


@pytest.mark.parametrize("page", [
    f'<main class="content has-sidebar">{TEXT}<div class="sidebar"><p>side</p></div></main>',
    f'<div id="page" class="with-header"><div class="header"><p>site</p></div><article>{TEXT}</article></div>',
    f'<article class="post no-comments">{TEXT}</article>',
    f'<div class="alert-article widget">{TEXT}</div>',
    f'<div class="alert-article widget"><article>{TEXT}</article></div><div class="widget"><p>w</p></div>',
    f'<div class="banner-page"><main class="notice">{TEXT}<section class="comments"><article class="comment"><p>{"long talk " * 50}</p></article></section></main></div>',
    f'<article class="share-post">{TEXT}<div class="share"><p>send</p></div></article><div class="related"><article><p>{"other story " * 40}</p></article></div><article class="teaser">x</article>',
    f'<body><div class="main">{TEXT}</div><section id="comments"><article class="comment"><p>{"long talk " * 50}</p></article></section></body>',
])
def test_layout_words_hide_no_main_text(page):
    got = P.extract(page, {})
    assert got.removesuffix("\nx") == PLAIN
