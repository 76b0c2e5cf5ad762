"""Writers: keyed messages, replay buffer and the table lake."""
