"""Small tables, as VALUES that Spark and SQL engines read alike, for operators whose cue words the tables don't hold."""

from __future__ import annotations

QUESTIONS = """(VALUES
(1, 'Hey, could you please tell me what was the original retention window before the migration? thanks'),
(2, 'please write me a summary of the queue design'),
(3, 'In what order did we add the cache layer?'),
(4, 'what is the current timeout of the uploads worker'),
(5, 'Hello'),
(6, 'how should I name the new service'),
(7, 'How many retries did we configure, as you know?'),
(8, CAST(NULL AS STRING)),
(9, 'show me the throughput of node-7 over time')) AS q(query_id, query)"""

TURNS = """(VALUES
(1, 'lesson', '[Session 3 | Date: March 4 | Turn #1/2] USER: please always use the blue queue for exports | ASSISTANT: noted, the blue queue it is'),
(2, 'lesson', '[Session 3 | Date: March 4 | Turn #3/9] USER: the parser crashed on unicode input. We switched to the new parser | ASSISTANT: fine'),
(3, 'lesson', '[Session 4 | Date: Session 4 | Turn #5] USER: the retention window is thirty days (Turn #5) | ASSISTANT: ok'),
(4, 'invariant', 'note about [Session_12] the parser keeps unicode'),
(5, 'lesson', 'plain text without a header | Turn #7 |'),
(6, 'lesson', ''),
(7, 'lesson', CAST(NULL AS STRING)),
(8, 'lesson', '[Session 4 | Date: March 9 | Turn #8/9] USER: we moved to the green queue and no longer use the blue one | ASSISTANT: understood'),
(9, 'lesson', '[Session 3 | Date: March 9 | Turn #10] USER: what about the parser tests | ASSISTANT: they pass')) AS t(id, category, content)"""

PATHS = """(VALUES
(1, 'a/src/main.py'), (2, 'src/.env'), (3, 'conf/.env.example'), (4, '.env.production'), (5, 'docs/README.md'), (6, 'package-lock.json'),
(7, 'keys/server.pem'), (8, 'b/./lib/x.js'), (9, '../etc/passwd'), (10, '/dev/null'), (11, 'LICENSE-MIT'), (12, 'license-validator.js'),
(13, './a//b.txt'), (14, 'projects/other/src/a.py'), (15, CAST(NULL AS STRING)), (16, 'id_rsa_backup'), (17, 'tools/uv.lock'), (18, 'CHANGELOG')) AS p(id, path)"""

RULES = """(VALUES
(1, 1, 'The cache layer must always be enabled for uploads'),
(1, 2, 'Never enable the cache layer for uploads'),
(1, 3, 'Retry timeout of uploads worker is 30s'),
(1, 4, 'Retry timeout of uploads worker is 45s'),
(1, 5, CAST(NULL AS STRING)),
(1, 6, 'The billing report runs at midnight'),
(2, 7, 'Backups of the ledger are required on tape'),
(2, 8, 'Backups of the ledger on tape are forbidden'),
(2, 9, 'Ledger quota 20 gb'),
(2, 10, 'unrelated note')) AS r(query_id, id, content)"""

NUGGETS = """(VALUES
('color', 1, 'set', 'the export queue is blue', 'project'),
('color', 4, 'set', 'the export queue is green', 'project'),
('owner', 2, 'set', 'maria owns the parser', 'user'),
('old', 3, 'set', 'retired fact', 'agent'),
('old', 5, 'forget', CAST(NULL AS STRING), CAST(NULL AS STRING)),
('bad', 6, 'set', 'value', 'nonsense'),
('', 7, 'set', 'no key', 'project')) AS n(key, seq, op, value, kind)"""

CHANGES = """(VALUES
(1, 1, 'insert', 'one', CAST(NULL AS BIGINT)), (2, 2, 'insert', 'two', CAST(NULL AS BIGINT)), (3, 3, 'insert', 'three', CAST(NULL AS BIGINT)),
(4, 4, 'insert', 'four', CAST(NULL AS BIGINT)), (1, 5, 'update', 'one, newer', CAST(NULL AS BIGINT)), (2, 6, 'supersede', CAST(NULL AS STRING), CAST(3 AS BIGINT)),
(3, 7, 'supersede', CAST(NULL AS STRING), CAST(4 AS BIGINT)), (4, 8, 'delete', CAST(NULL AS STRING), CAST(NULL AS BIGINT)), (5, 9, 'insert', 'five', CAST(NULL AS BIGINT)),
(5, 10, 'invalidate', CAST(NULL AS STRING), CAST(NULL AS BIGINT))) AS c(id, seq, op, content, target)"""

BLAME = """(VALUES
(1, 10, 'aaaaaaa1111111111111111111111111111111aa', 'feat: queue limits (#12)'), (1, 11, 'aaaaaaa1111111111111111111111111111111aa', 'feat: queue limits (#12)'),
(1, 15, 'aaaaaaa1111111111111111111111111111111aa', 'feat: queue limits (#12)'), (1, 12, 'bbbbbbb2222222222222222222222222222222bb', 'docs: typo (#13)'),
(1, 13, '0000000000000000000000000000000000000000', 'Not Committed Yet')) AS b(f, line, sha, summary)"""
