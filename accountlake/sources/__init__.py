"""Reading accounts and crawl dumps, writing payloads and run state."""
