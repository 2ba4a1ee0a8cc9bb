"""The term list that the behaviour tests share."""

TERMS = [
    ("敏感", "test-basic", "low"),
    ("敏感词汇", "test-basic", "medium"),
    ("违规词", "test-basic", "medium"),
    ("台湾独立", "test-politics", "medium"),
    ("badword", "test-en", "medium"),
    ("ass", "test-en", "low"),
    ("finance", "test-en", "low"),
    ("free money", "test-spam", "low"),
    ("爆炸物制造", "test-danger", "high"),
    ("冰", "test-drugs", "medium"),
    ("evil.example.com", "test-url", "medium"),
    ("spam@example.com", "test-url", "low"),
]
