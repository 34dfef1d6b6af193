"""Fixed schemas (DDL) of the tables and of the JSON documents read by the sources."""

from __future__ import annotations

TABLES = {
    "tracks": "track_id string, video_id string, title string, uploader string, duration double, "
              "thumbnail_url string, original_url string",
    "candidates": "track_id string, provider string, provider_ref string, artist string, "
                  "title string, album string, duration double, plain_text string, "
                  "lrc_text string, instrumental boolean, input_pos int",
    "lines": "track_id string, line_index int, text string, corrected_text string, "
             "translation string, start double, end double, confidence double",
    "words": "track_id string, line_index int, word_index int, text string, start double, "
             "end double, confidence double",
    "asr_words": "track_id string, pos int, text string, start double, end double, prob double",
    "spans": "track_id string, line_index int, start double, end double",
    "frames": "track_id string, frame int, energy double",
    "beats": "track_id string, t double",
    "onsets": "track_id string, t double",
    "sections": "track_id string, idx int, t double, repetition double",
    "segments": "track_id string, segment_start double, segment_end double, score double",
    "media_candidates": "provider string, provider_ref string, kind string, width int, height int, "
                        "page_url string, download_url string, thumb_url string, creator string, "
                        "creator_url string, license string, query string, tags string, "
                        "duration double",
    "assets": "job_id string, scene_index int, provider string, provider_ref string, kind string, "
              "width int, height int, page_url string, creator string, creator_url string, "
              "license string, query string, file_path string, phash bigint, score double, "
              "fetched_at timestamp",
    "exclusions": "job_id string, provider string, provider_ref string",
    "projects": "job_id string, url string, video_id string, title string, uploader string, "
                "duration double, audio_path string, style string, target_seconds double, "
                "segment_start double, created_at timestamp, updated_at timestamp",
    "outputs": "job_id string, file_path string, style string, duration double, "
               "created_at timestamp",
    "publishes": "job_id string, platform string, url string, privacy string, "
                 "created_at timestamp",
    "response_cache": "cache_key string, payload string, fetched_at timestamp",
    "memo": "k string, v string",
    "job_events": "job_id string, kind string, state string, message string, progress double, "
                  "error_code string, ts timestamp",
}

LYRIC_SEARCH_JSON = ("array<struct<id:string,artistName:string,trackName:string,albumName:string,"
                     "duration:double,plainLyrics:string,syncedLyrics:string,instrumental:boolean>>")

INFO_JSON = ("id string, title string, uploader string, channel string, duration double, "
             "thumbnail string")

_USER = "struct<name:string,url:string>"
_RENDITION = "struct<url:string,width:int,height:int>"
MEDIA_JSON = {
    ("pexels", "photo"): "photos array<struct<id:string,width:int,height:int,url:string,"
                         "photographer:string,photographer_url:string,alt:string,"
                         "src:struct<original:string,large2x:string,medium:string>>>",
    ("pexels", "video"): "videos array<struct<id:string,url:string,image:string,duration:double,"
                         f"user:{_USER},video_files:array<struct<link:string,width:int,height:int>>>>",
    ("pixabay", "photo"): "hits array<struct<id:string,imageWidth:int,imageHeight:int,"
                          "pageURL:string,largeImageURL:string,fullHDURL:string,"
                          "previewURL:string,user:string,user_id:string,tags:string>>",
    ("pixabay", "video"): "hits array<struct<id:string,pageURL:string,user:string,tags:string,"
                          f"duration:double,videos:struct<large:{_RENDITION},medium:{_RENDITION},"
                          f"small:{_RENDITION}>>>",
    ("unsplash", "photo"): "results array<struct<id:string,width:int,height:int,"
                           "urls:struct<raw:string,full:string,small:string>,"
                           "links:struct<html:string>,alt_description:string,description:string,"
                           "user:struct<name:string,links:struct<html:string>>>>",
}

LICENSED_PAGES_JSON = (
    "map<string,struct<index:int,title:string,imageinfo:array<struct<url:string,thumburl:string,"
    "descriptionurl:string,width:int,height:int,extmetadata:struct<"
    "LicenseShortName:struct<value:string>,DescriptionUrl:struct<value:string>,"
    "Artist:struct<value:string>>>>>>")
