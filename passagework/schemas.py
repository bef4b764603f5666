"""Declared schemas, as DDL; nothing is inferred."""

from __future__ import annotations

USERS = "id string, full_name string, email string, password_hash string, created_at timestamp, theme string, language string, email_verified_at timestamp"
DOCUMENTS = ("id string, user_id string, filename string, file_type string, file_size_bytes int, status string, content binary, created_at timestamp, "
    "chapter_breakdown array<struct<chapter:string,passages:int>>, failed_reason string, content_hash string, folder_id string"
)
FOLDERS = "id string, user_id string, name string, color string, created_at timestamp"
CHAT_MESSAGES = ("id string, user_id string, role string, question string, "
    "segments array<struct<text:string,citations:array<struct<chapter:string,document_filename:string,chunk_indexes:array<int>>>>>, empty_reason string, created_at timestamp"
)
PASSAGES = "chunk_id string, document_id string, user_id string, chapter string, chunk_index int, text string, embedding array<float>"
ENTITIES = "user_id string, name string, type string, document_id string"
EDGES = "user_id string, src_name string, src_type string, dst_name string, dst_type string, rel_type string, document_id string"
STATUS_EVENTS = "document_id string, seq long, status string, reason string"
QUESTIONS = "id string, category string, question string, expected_answer string, must_contain array<string>, match string, document_filenames array<string>"

# Fixed values of the data model.
ENTITY_TYPES = ("Person", "Organization", "Project", "Product", "Location")
RELATIONSHIP_TYPES = ("WORKS_AT", "SUPPLIES", "PART_OF", "LOCATED_IN", "RELATED_TO")
STATUSES = ("Uploaded", "Extracting", "Graphing", "Ready", "Failed")
FOLDER_COLORS = ("rose", "peach", "sun", "mint", "sky", "lilac")
EXTENSIONS = {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}
CONTENT_TYPES = {
    "pdf": ("application/pdf", "application/octet-stream"),
    "markdown": ("text/markdown", "text/x-markdown", "text/plain", "application/octet-stream"),
    "html": ("text/html", "application/xhtml+xml", "application/octet-stream"),
}
MEDIA_TYPES = {"pdf": "application/pdf", "markdown": "text/markdown", "html": "text/html"}
STAGE_LABELS = {
    "parsing": "Could not read this document",
    "indexing": "Could not index this document's content",
    "extraction": "Could not extract entities from this document",
    "graph_write": "Could not save extracted entities to the graph",
}
MAX_FILE_BYTES = 20 * 1024 * 1024
WHOLE = "Full Document"
CHUNK_WORDS, OVERLAP_WORDS = 250, 40
EXTRACTION_CHARS = PASSAGE_CHARS = 12_000
HISTORY_TURNS, HISTORY_CHARS = 3, 2_000
TOP_PASSAGES, RELEVANT_DISTANCE = 8, 0.75
TOP_NODES, MOST_EDGES = 150, 1_000
PAGE_SIZE = 20
