"""Explicit schemas of the entities; nothing is inferred from data."""

WORK = (
    "title string, url string, author string, cover string, description string, status string, source string, "
    "rating_value string, rating_count string, total_chapters_on_site bigint, "
    "categories array<struct<name:string,url:string>>, "
    "sources array<struct<url:string,site_key:string,priority:double,is_primary:boolean,total_chapters:bigint,last_update:string>>, "
    "site_key string, crawled_by string, crawled_at string, metadata_updated_at string, "
    "skip_crawl boolean, skip_reason string, meta_retry_count bigint"
)
STATE = ("site_key string, current_genre_url string, current_story_url string, current_story_index_in_genre bigint, "
         "processed_chapter_urls_for_current_story array<string>, globally_completed_story_urls array<string>")
JOB = (
    "type string, site_key string, site string, title string, url string, genre_name string, chapter_url string, chapter_title string, "
    "story_title string, story_url string, filename string, reason string, error_type string, crawl_mode string, story_folder_path string"
)
WARNING = "type string, raw_line string, story_title string, crawled_count bigint, dead_count bigint, total_count bigint, timestamp string"
