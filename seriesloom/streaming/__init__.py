"""The batch operators' expressions over streams, where these need no more than windows and watermarks."""
