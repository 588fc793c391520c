"""Example extraction profiles for the 16 listing sites and 18 body rules.

Profiles are user data: pass your own list to ``dispatch`` / ``ingest_run``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from gleaner.operators.extract import Profile

# Site base URLs, listing profiles (in listing-dispatch order) and
# body rules (in body-dispatch order, a different order).  Each listing profile:
# candidate tag/classes, wrapper use, link tag/classes, title tag/classes, date
# tag/class/attribute/index, container.  Each body rule: tag and class.
SOURCE_PROFILES = [
    Profile(source="deepmind", base_url="https://deepmind.google", rank=1,
            cand_tag="a", cand_classes=("glue-card card",), cand_mode="one",
            title_tag="p", title_classes=("glue-headline",),
            date_tag="time", date_attr="datetime",
            body_rank=11, body_tag="div", body_class="glue-page"),
    Profile(source="anthropic", base_url="https://www.anthropic.com", rank=2,
            cand_tag="a", cand_classes=("PostCard_post-card__z_Sqq",), cand_mode="one",
            title_tag="h3", title_classes=("PostCard_post-heading__Ob1pu",),
            date_tag="div", date_class="PostList_post-date__djrOA",
            body_rank=10, body_tag="div", body_class="Body_body__XEXq7"),
    Profile(source="openai", base_url="https://openai.com", rank=3,
            container_tag="div", container_class="grid @sm:grid-cols-2 @md:grid-cols-3 gap-x-sm gap-y-2xl",
            cand_tag="a", title_tag="div", title_classes=("text-h5",),
            date_tag="time", date_attr="datetime",
            body_rank=9, body_tag="article", body_class="flex flex-col"),
    Profile(source="google_research", base_url="https://research.google", rank=4,
            container_tag="ul", container_class="blog-posts-grid__cards",
            cand_tag="a", cand_classes=("glue-card",), cand_mode="one",
            title_tag="span", title_classes=("headline-5",),
            date_tag="p", date_class="glue-label",
            body_rank=8, body_tag="div", body_class="glue-grid__col"),
    Profile(source="huggingface", base_url="https://huggingface.co", rank=5,
            container_tag="div", container_class="col-span-1",
            cand_tag="a", cand_classes=("flex", "flex-col"), cand_mode="all",
            title_tag="h2", title_classes=("font-semibold",),
            date_tag="span", date_class="truncate",
            body_rank=7, body_tag="div", body_class="blog-content"),
    Profile(source="theverge", base_url="https://www.theverge.com", rank=6,
            cand_tag="div", cand_classes=("_184mfto4", "_1pm20r51", "_1dqvz267", "_1dqvz265"),
            cand_mode="any", wrapped=True, link_tag="a", link_classes=("_1lkmsmo1",),
            title_tag="a", title_classes=("_1lkmsmo1",),
            date_tag="time", date_attr="datetime",
            body_rank=6, body_tag="div", body_class="duet--layout--entry-body"),
    Profile(source="wired", base_url="https://www.wired.com", rank=7,
            cand_tag="div", cand_classes=("summary-item__content",), cand_mode="one", wrapped=True,
            link_tag="a", link_classes=("summary-item__hed-link",),
            title_tag="h3", title_classes=("summary-item__hed",),
            date_tag="time", date_class="summary-item__publish-date",
            body_rank=5, body_tag="div", body_class="ArticlePageChunks-fLyCVG"),
    Profile(source="venturebeat", base_url="https://venturebeat.com", rank=8,
            container_tag="div", container_class="story-river",
            cand_tag="article", cand_classes=("ArticleListing",), cand_mode="one", wrapped=True,
            link_tag="a", link_classes=("ArticleListing__title-link",),
            title_tag="a", title_classes=("ArticleListing__title-link",),
            date_tag="time", date_attr="datetime",
            body_rank=4, body_tag="div", body_class="article-content"),
    Profile(source="techcrunch", base_url="https://techcrunch.com", rank=9,
            cand_tag="div", cand_classes=("loop-card__content",), cand_mode="one", wrapped=True,
            link_tag="a", link_classes=("loop-card__title-link",),
            title_tag="a", title_classes=("loop-card__title-link",),
            date_tag="time", date_attr="datetime",
            body_rank=3, body_tag="div", body_class="wp-block-post-content"),
    Profile(source="aibusiness", base_url="https://aibusiness.com", rank=10,
            container_tag="div", container_class="LatestFeatured-ColumnList",
            cand_tag="div", cand_classes=("ListPreview-ContentWrapper",), cand_mode="one", wrapped=True,
            link_tag="a", link_classes=("ListPreview-Title",),
            title_tag="a", title_classes=("ListPreview-Title",),
            date_tag="span", date_class="ListPreview-Date",
            body_rank=2, body_tag="div", body_class="ArticleBase-BodyContent"),
    Profile(source="ilpost", base_url="https://www.ilpost.it", rank=11,
            container_tag="div", container_class="index_home-left__ikJqd",
            cand_tag="article", cand_classes=("_taxonomy-item_1moex_1",), cand_mode="one", wrapped=True,
            link_tag="a", title_tag="h2", title_classes=("_article-title_vvjfb_7",),
            date_tag="time", date_class="_taxonomy-item__time_1moex_37",
            body_rank=1, body_tag="div", body_class="contenuto"),
    Profile(source="mistral", base_url="https://mistral.ai", rank=12,
            container_tag="div", container_id="news-section",
            cand_tag="div", cand_classes=("blog-fade-in",), cand_mode="one", wrapped=True,
            link_tag="a", title_tag="h3", date_tag="span", date_index=1,
            body_rank=14, body_tag="div", body_class="blog-rich-text"),
    Profile(source="perplexity_ai", base_url="https://www.perplexity.ai", rank=13,
            container_tag="div", container_class="framer-1pk4ise",
            cand_tag="a", cand_classes=("framer-fkCik",), cand_mode="one",
            title_tag="h4", title_classes=("framer-text",),
            date_tag="p", date_class="framer-text",
            body_rank=15, body_tag="div", body_class="framer-tef8j0"),
    Profile(source="xai", base_url="https://x.ai", rank=14,
            container_tag="div", container_class="sm:gap-6",
            cand_tag="div", cand_classes=("flex-col",), cand_mode="one", wrapped=True,
            link_tag="a", title_tag="h4", title_classes=("text-lg",),
            date_tag="span", date_class="mono-tag",
            body_rank=17, body_tag="section", body_class="py-16"),
    Profile(source="meta_ai", base_url="https://ai.meta.com", rank=15,
            container_tag="div", container_class="_amd6",
            cand_tag="div", cand_classes=("_amdc",), cand_mode="one", wrapped=True,
            link_tag="a", link_classes=("_amcw _amdf",),
            title_tag="a", title_classes=("_amcw _amdf",),
            date_tag="div", date_class="_amdj", date_index=1,
            body_rank=16, body_tag="div", body_class="_7h8s"),
    Profile(source="arxiv", base_url="https://arxiv.org", rank=16, parser="paper",
            body_rank=18, body_tag="blockquote", body_class="abstract"),
    # body rules only (no listing rule)
    Profile(source="google_blog", base_url="https://blog.google",
            body_rank=12, body_tag="article", body_class="uni-article-wrapper"),
    Profile(source="google_developers_blog", base_url="https://developers.googleblog.com",
            body_rank=13, body_tag="div", body_class="blog-detail-container"),
]


@dataclass(frozen=True)
class HeaderRule:
    """The extra header article some listing pages show above the list."""

    source: str
    base_url: str
    container_tag: str
    container_class: Optional[str]
    link_tag: str
    link_class: Optional[str]
    href_mode: str = "raw"                  # raw | drop_first_char
    date_tag: Optional[str] = None
    date_class: Optional[str] = None
    date_format: Optional[str] = None       # required format; unparsable -> null


# The two header rules.
HEADER_RULES = [
    HeaderRule(source="perplexity_ai", base_url="https://www.perplexity.ai",
               container_tag="div", container_class="framer-1qu7j16-container",
               link_tag="a", link_class="framer-text", href_mode="drop_first_char"),
    HeaderRule(source="meta_ai", base_url="https://ai.meta.com",
               container_tag="div", container_class="_amc_",
               link_tag="a", link_class="_amcw _amd2", href_mode="raw",
               date_tag="div", date_class="_amun", date_format="MMMM d, yyyy"),
]
