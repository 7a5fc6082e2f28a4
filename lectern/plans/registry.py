"""All queries of the engine by name, with the SQL that states the same result."""

from lectern.plans import queries, queries_books, queries_fixture, queries_images, queries_text

QUERIES: dict = queries.Q | queries_fixture.Q | queries_books.Q | queries_images.Q | queries_text.Q
ORACLE_SQL: dict = queries.SQL | queries_fixture.SQL | queries_books.SQL | queries_images.SQL | queries_text.SQL
