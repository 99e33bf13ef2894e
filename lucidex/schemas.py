"""Schemas of the tables the engine reads and writes.

Times are zone-less UTC, so results do not depend on a session's time zone.
"""

from __future__ import annotations

CONTENT = (
    "site_id string, content_id bigint, post_type string, status string, password string, slug string, "
    "title string, excerpt string, body_html string, permalink string, published_at timestamp_ntz, "
    "modified_at timestamp_ntz, terms array<struct<taxonomy:string,term_id:bigint,slug:string>>, "
    "robots array<string>, fields_json string"
)
CONTENT_META = "site_id string, content_id bigint, key string, value string"
ROBOTS = "site_id string, content_id bigint, robots_default boolean, robots_noindex boolean"
DESCRIPTIONS = (
    "site_id string, content_id bigint, auto string, manual string, generated_for timestamp_ntz, "
    "generator_version string, job_status string"
)
STORE = (
    "site_id string, content_id bigint, content_hash string, markdown string, generated_at timestamp_ntz, "
    "converter_version string, quality_score int, signals string"
)
STATUS = "site_id string, content_id bigint, status string, generated_at timestamp_ntz"
PROFILE = (
    "site_id string, exposed_types array<string>, exposed_statuses array<string>, excluded_ids array<string>, "
    "excluded_slugs array<string>, excluded_term_ids array<string>, excluded_term_slugs array<string>, "
    "descriptions_enabled boolean, structured_data_enabled boolean, markdown_enabled boolean, "
    "advertise_enabled boolean, exclude_samples boolean, channels_enabled boolean, allow_inference boolean, "
    "allow_training boolean, full_index_enabled boolean, content_link_enabled boolean, static_mode string, "
    "utility_ids array<bigint>, seo_posture string, client_configured boolean, static_robots boolean, "
    "site_name string, tagline string, home_url string, sitemap_url string, language string"
)
EDITORIAL = (
    "site_id string, position bigint, title string, url string, description string, section string, "
    "section_label string"
)
CHANGES = "site_id string, content_id bigint, kind string, ts timestamp"
