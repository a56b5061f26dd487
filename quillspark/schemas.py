"""Explicit schemas of the files that are read and written."""

SOURCE = "struct<file:string,page_start:int,page_end:int,section:string,article:string>"
METADATA = (
    "struct<law_name:string,law_type:string,law_number:string,effective_date:string,section:string,chapter:string,chapter_title:string,"
    "subsection:string,subsection_title:string,article:string,article_title:string,paragraph:string,item:string,chunk_type:string,"
    f"parent_id:string,page_start:int,page_end:int,chunk_index:int,chunk_count:int,source:{SOURCE}>"
)
CHUNKS = f"id string, text string, metadata {METADATA}"
LINES = "document string, page int, line_no int, line string"
QUERIES = "id long, query string, expected_law string, expected_article string, expected_chunk_id string, query_type string, difficulty string"
FIXES = "id long, action string, new_query string, new_law string, new_article string, new_chunk_id string, reason string"
