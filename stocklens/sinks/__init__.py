"""Writers of bills of materials."""
